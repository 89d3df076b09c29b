"""Labelled pages for the content model: layouts of common kinds with invented text.

An attribute data-main marks a block and what is in it: "1" is main text, "0" is not.
"""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi re tu sa ne po li va do er an ti on us".split()
MENUS = ("nav", "menu", "navbar", "topnav", "navigation", "main-menu", "site-nav", "breadcrumbs", "breadcrumb", "pager", "pagination")
HEADS = ("header", "site-header", "masthead", "topbar", "page-header", "logo", "branding", "brand")
FEET = ("footer", "site-footer", "page-footer", "copyright", "legal", "colophon", "credits")
SIDES = ("sidebar", "side", "aside", "widget", "widget-area", "related", "related-posts", "recommended", "popular", "trending", "more", "tags", "toc")
ADS = ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "teaser")
NOTICES = ("cookie", "cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "privacy-notice", "alert", "popup", "modal", "banner", "newsletter", "subscribe", "signup", "paywall")
SOCIAL = ("share", "social", "share-buttons", "social-links", "follow")
COMMENTS = ("comments", "comment-list", "comment", "discussion", "replies", "responses", "reviews", "disqus", "respond", "comment-body")
CONTENT = ("content", "main-content", "article", "article-body", "entry-content", "entry", "post", "post-content", "story", "story-body", "text", "body-text", "main", "page-content")
BODY = ("lead", "intro", "first", "text", "paragraph", "body", "p1", "indent", "justify", "quote", "caption", "summary", "note")


class Writer:
    """Draws texts and layouts from one seed."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        word = lambda: "".join(self.draw.choices(SYLLABLES, k=self.draw.randint(1, 4)))
        return " ".join(word() for _ in range(self.draw.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        mark = lambda: self.draw.choice(".....!?")
        return " ".join(self.words(3, 14).capitalize() + mark() for _ in range(self.draw.randint(low, high)))

    def pick(self, names: tuple[str, ...]) -> str:
        return f'{self.draw.choice(("class", "class", "id"))}="{self.draw.choice(names)}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.draw.randint(low, high))]
        if self.draw.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items)

    def noise(self, tag: str, names: tuple[str, ...], inside: str) -> str:
        mark = f" {self.pick(names)}" if tag in ("div", "section", "p", "ul", "span") or self.draw.random() < 0.4 else ""
        return f'<{tag}{mark} data-main="0">{inside}</{tag}>'

    def paragraph(self) -> str:
        kind, text = self.draw.random(), self.sentences(1, 8)
        if kind < 0.06:
            return f"<p>{self.words(1, 6).capitalize()}.</p>"
        if kind < 0.2:
            return f"<p><b>{self.sentences(1, 2)}<br><p>{text}</p>"
        if kind < 0.3:
            return f'<p>{text} <a href="/x">{self.words(1, 4)}</a> {self.sentences(1, 2)}</p>'
        if kind < 0.36:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.42:
            return "<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(self.draw.randint(2, 5))) + "</ul>"
        if kind < 0.46:
            row = lambda: "<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>"
            return "<table>" + "".join(row() for _ in range(self.draw.randint(2, 4))) + "</table>"
        if kind < 0.5:
            return f'<figure><img src="a.png"><figcaption>{self.sentences(1, 1)}</figcaption></figure>'
        if kind < 0.54:
            return f"<pre>{self.words(3, 20)}</pre>"
        if kind < 0.6:
            return f"<h{self.draw.randint(2, 4)}>{self.words(1, 7).capitalize()}</h3>"
        mark = f' class="{self.draw.choice(BODY + (self.words(1, 1),))}"' if self.draw.random() < 0.2 else ""
        return f"<p{mark}>{text}</p>"

    def aside(self) -> str:
        """One block that is not main text."""
        kind = self.draw.randrange(8)
        if kind == 0:
            return self.noise("div", ADS, self.sentences(1, 3))
        if kind == 1:
            return self.noise(self.draw.choice(("aside", "div", "section")), SIDES, f"<h3>{self.words(1, 3)}</h3>{self.links(2, 6)}")
        if kind == 2:
            return self.noise("div", NOTICES, f"<p>{self.sentences(1, 3)}</p><button>{self.words(1, 2)}</button>")
        if kind == 3:
            return self.noise("div", SOCIAL, self.links(2, 4))
        if kind == 4:
            form = f"<label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>"
            return self.noise("form", NOTICES, f"<p>{self.sentences(1, 1)}</p>{form}<button>{self.words(1, 2)}</button>")
        if kind == 5:
            return self.noise("aside", SIDES, f"<p>{self.sentences(1, 3)}</p>")
        if kind == 6:
            return self.noise("p", ADS + NOTICES, self.sentences(1, 2))
        return self.noise("div", SIDES, f"<p>{self.sentences(1, 2)}</p>{self.links(1, 3)}")

    def comments(self) -> str:
        each = lambda: f'<div class="{self.draw.choice(COMMENTS)}"><b>{self.words(1, 2)}</b><p>{self.sentences(1, 5)}</p></div>'
        title = f"<h3>{self.words(1, 2)}</h3>" if self.draw.random() < 0.7 else ""
        inside = title + "".join(each() for _ in range(self.draw.randint(1, 5)))
        if self.draw.random() < 0.3:
            inside = title + "<ol>" + "".join(f"<li><p>{self.sentences(1, 4)}</p></li>" for _ in range(3)) + "</ol>"
        return self.noise(self.draw.choice(("section", "div")), COMMENTS, inside)

    def article(self) -> str:
        title = f"<h1>{self.words(2, 10).capitalize()}</h1>" if self.draw.random() < 0.8 else ""
        kind = self.draw.random()
        if kind < 0.15:  # verses, lists of results: very many short paragraphs
            parts = [f"<p>{self.words(1, 5).capitalize()}.</p>" for _ in range(self.draw.randint(5, 60))]
        elif kind < 0.25:
            parts = [f"<p>{self.sentences(20, 60)}</p>" for _ in range(self.draw.randint(1, 3))]
        else:
            parts = [self.paragraph() for _ in range(self.draw.choice((1, 2, 4, 7, 12, 25)))]
        for _ in range(self.draw.choice((0, 0, 0, 1, 2))):
            parts.insert(self.draw.randint(0, len(parts)), self.aside())
        if self.draw.random() < 0.15:
            parts.append(self.comments())
        inside = title + "".join(parts)
        kind = self.draw.random()
        if kind < 0.55:
            mark = f" {self.pick(CONTENT)}" if self.draw.random() < 0.3 else ""
            return f'<article{mark} data-main="1">{inside}</article>'
        if kind < 0.75:
            return f'<main data-main="1">{inside}</main>'
        return f'<div {self.pick(CONTENT)} data-main="1">{inside}</div>'

    def page(self) -> str:
        one = lambda tag, names, text: self.noise(self.draw.choice((tag, "div")), names, text)
        body = []
        if self.draw.random() < 0.3:
            body.append(self.noise("div", NOTICES, f"{self.sentences(1, 2)}<button>{self.words(1, 1)}</button>"))
        if self.draw.random() < 0.6:
            rank = self.draw.randint(1, 3)
            body.append(one("header", HEADS, f"<h{rank}>{self.words(1, 4)}</h{rank}><p>{self.words(2, 8)}</p>"))
        if self.draw.random() < 0.9:
            body.append(one("nav", MENUS, self.links(3, 9)))
        body += [self.aside() for _ in range(self.draw.choice((0, 1, 1, 2)))]
        body.append(self.article())
        body += [self.aside() for _ in range(self.draw.choice((0, 0, 1, 2)))]
        if self.draw.random() < 0.35:
            body.append(self.comments())
        if self.draw.random() < 0.9:
            body.append(one("footer", FEET, f"&copy; {self.words(1, 4)} &middot; {self.sentences(1, 2)}"))
        inside = "".join(body)
        if self.draw.random() < 0.3:
            inside = f'<div class="{self.draw.choice(("wrapper", "container", "page", "site", "layout"))}">{inside}</div>'
        head = f"<head><meta charset=utf-8><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head>"
        return f'<!DOCTYPE html><html lang="en">{head}<body>{inside}</body></html>'


def labelled_pages(count: int = 1200, seed: int = 9) -> list[str]:
    return [Writer(seed * 1_000_003 + i).page() for i in range(count)]
