"""Labelled pages to train the extraction model on: layouts of many kinds around an article, with the article's blocks known.

Words are invented; what the pages teach is structure. Elements of the frame (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments) are drawn from the ways in which they are commonly marked up, with and without telling names.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

PAGES, SEED = 600, 11
_PARTS = "ba be bi do du fa go ka ke lo ma mi na no pe ra ri sa so ta te ti to va ve vo zu".split()


class Maker:
    def __init__(self, rng: random.Random):
        self.rng, self.blocks = rng, []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(_PARTS) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 24) -> str:
        text = self.words(low, high).capitalize()
        if self.rng.random() < 0.3:
            text = text.replace(" ", ", ", 1)
        return text + self.rng.choice([".", ".", ".", "", "!", "?", " &", "%"])

    def prose(self) -> str:
        r = self.rng
        odd = r.random()
        if odd < 0.06:  # what crawled text also has: one word again and again, capitals, signs, cells
            return " ".join([self.words(1, 1)] * r.randint(2, 200))
        if odd < 0.12:
            return "!! ".join(self.words(1, 1).upper() for _ in range(r.randint(1, 60)))
        if odd < 0.18:
            return r.choice([" | ", "&&& ", "### ", " "]).join(self.words(1, 1) for _ in range(r.randint(1, 120)))
        low, high = r.choice([(1, 1), (1, 3), (2, 8), (4, 12)])
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def kept(self, text: str) -> str:
        """Marks a block as content and escapes it."""
        self.blocks.append(" ".join(text.split()))
        return html.escape(text, quote=self.rng.random() < 0.5)

    def named(self, tag: str, names: str, inner: str, chance: float = 0.8) -> str:
        r = self.rng
        if r.random() >= chance:
            return f"<{tag}>{inner}</{tag}>"
        key = r.choice(["class", "class", "id"])
        value = r.choice(names.split()) + r.choice(["", "", f"-{r.randint(1, 9)}", "-wrap", " box"])
        return f'<{tag} {key}="{value}">{inner}</{tag}>'

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.rng.randint(low, high))]
        style = self.rng.random()
        if style < 0.65:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if style < 0.85 else "".join(f"<p>{x}</p>" for x in items)

    def paragraphs(self) -> str:
        r, out = self.rng, []
        again = self.sentence(1, 3) if r.random() < 0.12 else ""  # a line that repeats
        for _ in range(r.randint(10, 60) if again else r.choice([1, 1, r.randint(1, 9), r.randint(3, 9), r.randint(8, 24)])):
            if again and r.random() < 0.8:
                out.append(f"<p>{self.kept(again)}</p>")
                continue
            kind = r.random()
            if kind < 0.68:
                text = self.prose()
                inner = self.kept(text)
                if r.random() < 0.15:
                    inner = f"<b>{inner}<br>" if r.random() < 0.5 else f"<em>{inner}</em>"
                out.append(f"<p>{inner}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.78:
                level = r.choice("23")
                out.append(f"<h{level}>{self.kept(self.words(1, 8))}</h{level}>")
            elif kind < 0.85:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.kept(self.sentence())}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{self.kept(self.prose())}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{self.kept(self.words(1, 4))}</td><td>{self.kept(self.words(1, 4))}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.945:
                out.append(f"<details{r.choice(['', ' open'])}><summary>{self.kept(self.words(1, 6))}</summary>" + "".join(f"<p>{self.kept(self.prose())}</p>" for _ in range(r.randint(1, 2))) + "</details>")
            elif kind < 0.955:
                tag, inner = r.choice(["object", "noscript", "noscript"]), f"<p>{self.kept(self.prose())}</p>"
                out.append(f"<{tag}>{inner}</{tag}>")
            elif kind < 0.975:
                out.append(f"<figure><img src=x><figcaption>{self.kept(self.sentence())}</figcaption></figure>")
            else:
                out.append(f"<pre>{self.kept(self.sentence())}</pre>")
            if r.random() < 0.06:
                out.append(self.advert())
            if r.random() < 0.03:
                out.append(self.named("div", "share social related newsletter", self.links(2, 4), 1))
        return "".join(out)

    def advert(self) -> str:
        return self.named(self.rng.choice(["div", "div", "aside", "section"]), "ad ads advert sponsored promo advertisement", self.text_or_links(), 1)

    def text_or_links(self) -> str:
        r = self.rng.random()
        return html.escape(self.prose()) if r < 0.5 else f"<p>{html.escape(self.prose())}</p>" if r < 0.8 else self.links(1, 4)

    def notice(self) -> str:
        if self.rng.random() < 0.15:
            return f"<noscript>{self.rng.choice(['', '<p>'])}{html.escape(self.sentence(3, 12))}</noscript>"
        return self.named(self.rng.choice(["div", "div", "section", "aside"]), "cookie consent notice alert popup newsletter subscribe gdpr modal", self.text_or_links() + self.rng.choice(["", "<button>ok</button>"]), 1)

    def menu(self) -> str:
        return f"<nav>{self.links()}</nav>" if self.rng.random() < 0.7 else self.named(self.rng.choice(["div", "ul"]), "nav menu breadcrumb navbar navigation", self.links(), 1)

    def header(self) -> str:
        inner = self.rng.choice(["", f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(1, 6)}</p>", f"<a href=/>{self.words(1, 2)}</a>"]) + self.rng.choice(["", self.menu()])
        return f"<header>{inner}{self.words(0, 3)}</header>" if self.rng.random() < 0.7 else self.named("div", "header masthead topbar branding", inner, 1)

    def footer(self) -> str:
        r = self.rng
        inner = r.choice(["&copy; ", "Copyright ", ""]) + self.words(1, 3) + r.choice([" &middot; ", " "]) + html.escape(self.prose()) + r.choice(["", self.links(2, 4)])
        inner = inner if r.random() < 0.6 else f"<p>{inner}</p>"
        return f"<footer>{inner}</footer>" if r.random() < 0.8 else self.named("div", "footer colophon copyright legal", inner, 1)

    def side(self) -> str:
        inner = self.rng.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + self.rng.choice([self.links(), self.text_or_links()])
        return self.named("aside", "sidebar related widget", inner, 0.4) if self.rng.random() < 0.6 else self.named("div", "sidebar related widget rail recommended", inner, 1)

    def form(self) -> str:
        return f"<form action=/x><label>{self.words(1, 3)}</label><input name=q>{self.rng.choice(['', f'<p>{self.prose()}</p>', '<select><option>a<option>b</select>'])}<button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        one = lambda: self.named(self.rng.choice(["div", "li", "p"]), "comment reply comment-body", f"<b>{self.words(1, 2)}</b> " + self.rng.choice([html.escape(self.prose()), f"<p>{html.escape(self.prose())}</p>"]), 0.6)
        return self.named(self.rng.choice(["div", "section", "ul", "ol"]), "comments discussion responses reader-comments replies", self.rng.choice(["", f"<h2>{self.words(1, 3)}</h2>"]) + "".join(one() for _ in range(self.rng.randint(1, 5))), 1)

    def page(self, layout: str = "") -> str:
        """layout: one of LAYOUTS; by default that of most pages, with the frame's elements around the article."""
        r = self.rng
        some = lambda chance, make: make() if r.random() < chance else ""
        title = self.words(2, 9)
        level = r.choice([1, 1, 2, 0]) if layout != "bare" or r.random() < 0.4 else 0
        head = f"<h{level}>{self.kept(title)}</h{level}>" if level else ""
        inside = head + some(0.08, self.advert) + self.paragraphs() + some(0.06, self.comments) + some(0.05, self.side) + some(0.04, self.form)
        top = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>p{{}}</style></head><body>'
        if layout == "bare":  # an article and nothing else
            return r.choice([top, "", "<html><body>"]) + (inside if r.random() < 0.7 else f"<div>{inside}</div>")
        if layout == "table":  # rows of a table: the frame's in cells of their own
            left = f"<td>{self.menu()}{some(0.5, self.side)}</td>"
            return f"{top}<table><tr><td colspan=2>{self.header()}</td></tr><tr>{left}<td>{inside}</td></tr><tr><td colspan=2>{self.footer()}</td></tr></table></body></html>"
        if layout == "roles":  # nothing but divs, told apart by role
            role = lambda name, inner: f'<div role="{name}">{inner}</div>'
            return top + role("banner", self.links(1, 2)) + role("navigation", self.links()) + role("main", inside) + some(0.5, lambda: role("complementary", self.side())) + role("contentinfo", f"&copy; {html.escape(self.prose())}")
        if layout == "deep":  # the article at the bottom of divs without names
            for _ in range(r.randint(3, 6)):
                inside = f"<div>{inside}</div>"
            return f"{top}{self.header()}<div><div>{self.menu()}</div>{inside}</div>{self.footer()}"
        style = r.random()
        if style < 0.5:
            body = f"<article>{inside}</article>"
        elif style < 0.65:
            body = f"<main>{inside}</main>"
        elif style < 0.85:
            body = self.named("div", "content post entry article-body story main", inside, 1)
        else:
            body = r.choice([inside, f"<div>{inside}</div>", f"<section>{inside}</section>"])
        if r.random() < 0.2:
            body = f"<div>{body}</div>"
        before = [some(0.5, self.header), some(0.8, self.menu), some(0.5, self.advert), some(0.25, self.notice), some(0.2, self.form), some(0.15, self.side)]
        after = [some(0.3, self.side), some(0.3, self.comments), some(0.25, self.advert), some(0.15, self.notice), some(0.15, self.form), some(0.85, self.footer)]
        r.shuffle(before)
        return top + "".join(before) + "<script>var a = '<p>';</script>" + body + "".join(after) + r.choice(["", "</body></html>"])


#: Layouts that are trained on, the first for most pages; and ones held out whole.
LAYOUTS, HELD_OUT = ("",) * 9 + ("bare",), ("table", "roles", "deep")


def labelled_pages(n: int = PAGES, seed: int = SEED, layouts: tuple[str, ...] = LAYOUTS) -> Iterator[tuple[str, list[str]]]:
    """(page, its content blocks in page order)."""
    for i in range(n):
        maker = Maker(random.Random(seed * 1_000_003 + i))
        page = maker.page(layouts[i % len(layouts)])
        yield page, maker.blocks
