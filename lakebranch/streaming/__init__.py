"""Work that goes on where it stopped."""
