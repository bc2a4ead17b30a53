"""Classification of changes, migration plans, and rendering of statements."""
