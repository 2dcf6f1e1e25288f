"""Labelled pages from a page grammar, to fit the costs of ``html_text``.

A page is made of parts in the orders and mark-up that sites use: articles in ``article``,
``main``, plain ``div`` or table cells; menus, notices, adverts, sidebars, forms, related
links, reader comments and footers with telling, neutral or no names. Every element with
text carries its label in the attribute ``LABEL``. Words are random, so that only the
form of a block can be learnt.
"""

from __future__ import annotations

import random

LABEL = "data-lodestone-label"
_SYLLABLES = "an ber cor da el for gi hen il jo ka len mor na os per qui ra sen tor und vi wen ys za".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, n: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))

    def sentence(self) -> str:
        return self.words(self.rng.randint(3, 18)).capitalize() + self.rng.choice(".....!?")

    def prose(self, least: int = 1, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(least, most)))

    def link(self, n: int | None = None) -> str:
        return f'<a href="/{self.words(1)}">{self.words(n or self.rng.randint(1, 4)).capitalize()}</a>'

    def open(self, names: str, tag: str = "div") -> str:
        """A start tag with one of the names, a neutral one, or none."""
        kind = self.rng.random()
        if kind < 0.6:
            name = self.rng.choice(names.split())
            return f'<{tag} {self.rng.choice(["class", "id"])}="{name}">'
        return f'<{tag} class="c{self.rng.randint(1, 99)}">' if kind < 0.8 else f"<{tag}>"

    def part(self, y: int, tag: str, text: str) -> str:
        return f'<{tag} {LABEL}="{y}">{text}</{tag}>'

    def links(self, y: int = 0) -> str:
        r = self.rng
        if r.random() < 0.7:
            return "<ul>" + "".join(self.part(y, "li", self.link()) for _ in range(r.randint(2, 8))) + "</ul>"
        return self.part(y, "div", r.choice([" | ", " ", " - "]).join(self.link() for _ in range(r.randint(2, 8))))

    def paragraph(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.15:
            return self.part(1, "p", self.words(r.randint(1, 6)).capitalize() + r.choice([".", "", ":"]))
        text = self.prose()
        if kind < 0.35:
            text += f" {self.link(r.randint(2, 6))} " + self.sentence()
        return self.part(1, r.choice(["p"] * 8 + ["div", "blockquote", "pre"]), text)

    def body(self) -> str:
        r = self.rng
        out = [self.part(1, "h1", self.words(r.randint(2, 9)).capitalize())] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 9)):
            out.append(self.paragraph())
            kind = r.random()
            if kind < 0.1:
                out.append(self.part(1, r.choice(["h2", "h3"]), self.words(r.randint(1, 5)).capitalize()))
            elif kind < 0.17:
                out.append("<ul>" + "".join(self.part(1, "li", self.words(r.randint(1, 12))) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.21:
                out.append("<table>" + "".join("<tr>" + "".join(self.part(1, "td", self.words(r.randint(1, 3))) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.27:
                out.append(self.advert())
            elif kind < 0.30:
                out.append(f"<aside>{self.part(0, 'p', self.prose(1, 3))}</aside>")
            elif kind < 0.33:
                out.append(f"<figure><img src=x>{self.part(1, 'figcaption', self.sentence())}</figure>")
        if r.random() < 0.25:
            out.append(self.open("share social sharing-buttons tags post-tags") + self.links() + "</div>")
        return "".join(out)

    def advert(self) -> str:
        inner = self.rng.choice([lambda: self.prose(1, 2), lambda: self.link(5), lambda: self.words(4)])()
        if self.rng.random() < 0.4:
            return self.open("ad ads advert sponsored promo banner-ad")[:-1] + f' {LABEL}="0">{inner}</div>'
        return self.open("ad ads advert sponsored promo banner-ad") + self.part(0, self.rng.choice(["p", "div"]), inner) + "</div>"

    def content(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.45:
            name = r.choice(["", "", ' class="post legal"', ' class="entry tags-open"'])
            return f"<article{name}>{self.body()}</article>"
        if kind < 0.6:
            return f"<main>{self.body()}</main>"
        if kind < 0.7:
            return self.body()
        if kind < 0.9:
            return self.open("content post entry-content story article-body text") + self.body() + "</div>"
        return f"<table><tr><td>{self.links()}</td><td>{self.body()}</td></tr></table>"

    def before(self) -> list[str]:
        r = self.rng
        parts = [
            lambda: f"<nav>{self.links()}</nav>",
            lambda: self.open("menu nav navbar main-menu topbar") + self.links() + "</div>",
            lambda: f"<header>{self.part(0, r.choice(['div', 'p', 'h2']), self.words(3))}{self.links()}</header>",
            lambda: self.open("cookie-notice consent gdpr alert") + self.part(0, "p", self.prose(1, 2)) + self.link(1) + "</div>",
            lambda: self.open("breadcrumbs breadcrumb") + self.part(0, "p", " &gt; ".join(self.link(1) for _ in range(3))) + "</div>",
            self.advert,
        ]
        return [r.choice(parts)() for _ in range(r.randint(0, 3))]

    def after(self) -> list[str]:
        r = self.rng
        comment = lambda: f'{self.open("comment", "div")}{self.part(0, "p", self.prose(1, 3))}</div>'
        teaser = lambda: self.part(0, "h3", self.link(5)) + self.part(0, "p", self.sentence())
        parts = [
            lambda: f"<aside>{self.part(0, 'h3', self.words(2))}{self.part(0, 'p', self.prose(1, 2))}{self.links()}</aside>",
            lambda: self.open("sidebar widget") + self.part(0, "p", self.prose(1, 2)) + self.links() + "</div>",
            lambda: '<div id="comments">' + "".join(comment() for _ in range(r.randint(1, 6))) + "</div>",
            lambda: self.open("related recommended more-stories popular") + "".join(teaser() for _ in range(r.randint(1, 4))) + "</div>",
            lambda: f"<form>{self.part(0, 'p', self.prose(1, 2))}<input>{self.part(0, 'div', self.words(2))}</form>",
            lambda: self.open("newsletter subscribe signup") + self.part(0, "p", self.prose(1, 2)) + "</div>",
            self.advert,
        ]
        return [r.choice(parts)() for _ in range(r.randint(0, 3))]

    def footer(self) -> str:
        r = self.rng
        text = r.choice(["&copy; ", "Copyright ", "All rights reserved. ", ""]) + self.words(4) + ". " + self.prose(0, 2)
        tag = r.choice(["footer", "footer", 'div class="footer"', 'div id="legal"'])
        return f"<{tag}>{self.part(0, 'p', text)}{self.links() if r.random() < 0.5 else ''}</{tag.split()[0]}>"

    def page(self) -> str:
        r = self.rng
        inner = "".join(self.before()) + self.content() + "".join(self.after()) + (self.footer() if r.random() < 0.8 else "")
        kind = r.random()
        if kind < 0.1:
            inner = f"<form action=/>{inner}</form>"
        elif kind < 0.3:
            inner = f'<div class="{r.choice(["page with-sidebar", "layout header-fixed", "wrapper"])}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{inner}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(n)]
