"""Labelled pages the tree model learns from: layouts drawn from a small grammar, with a label on every block.

A class word ``__c``, ``__b`` or ``__f`` labels an element as content, boilerplate or frame; elements without one share their
parent's label. Training takes these words away before it looks at the page.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

MARKS = {"__b": 0, "__c": 1, "__f": 2}
SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an el in or un th st".split()

# How sites name their blocks.
ARTICLES = ["article", "article", "article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "div#main-content", "section.article", "div.post-content", "main.page-content", "div#content", "div.text", "article.post", "section", "div.blog-post", "td.content"]
FRAMES = ["div#page", "div.wrapper", "div.container", "div", "div#root", "section.layout", "div.row"]
SIDES = ["aside", "div.sidebar", "aside.sidebar", "div#sidebar", "div.widget", "section.widgets", "div.right-rail", "div.side"]
ADS = ["div.ad", "div.ads", "div.advert", "div.advertisement", "ins.adsbygoogle", "div.sponsored", "div#ad-banner", "section.promo", "p.ad", "aside.ad", "div.promoted", "div.ad-slot", "p.sponsor"]
NOTICES = ["div.cookie-banner", "div#cookie-notice", "div.consent", "div.notice", "div.newsletter", "section.subscribe", "div.popup", "div.modal", "p.notice", "div.alert", "dialog", "aside.notice", "div.gdpr", "section.newsletter-signup", "div.paywall"]
COMMENTS = ["div.comments", "section#comments", "ol.commentlist", "div#disqus_thread", "section.comments", "div.comment-list", "div.reader-comments", "div.discussion", "ul.comments"]
MENUS = ["nav", "div.menu", "ul.nav", "nav.navbar", "div#navigation", "div.breadcrumb", "nav.breadcrumbs", "ul.menu", "div.pagination"]
TOPS = ["header", "div.header", "header.site-header", "div#masthead", "div.topbar", "header#top", "div#header"]
BOTTOMS = ["footer", "div.footer", "footer.site-footer", "div#footer", "div.copyright", "footer#colophon", "p.footer"]
RELATED = ["div.related", "section.related-posts", "div.recommended", "aside.related", "div.popular", "ul.related"]
SHARES = ["div.share", "ul.social", "div.social-share", "div.tags", "p.share"]
FORMS = ["form", "form.search", "form#login", "form.contact-form", "div.search-form", "form.feedback"]


def labels(name: str, tag: str) -> int | None:
    """Label of an element by its class words; none: the parent's."""
    return next((MARKS[w] for w in name.split() if w in MARKS), 2 if tag == "html" and not name else None)


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def some(self, low: int, high: int) -> range:
        return range(self.r.randint(low, high))

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in self.some(1, 4))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in self.some(low, high))

    def sentence(self) -> str:
        return self.words(2, 16).capitalize() + self.r.choice(".....!?")

    def text(self) -> str:
        """One word to many sentences, the same in articles and elsewhere: the wording tells nothing about the block."""
        most = self.r.choice([1, 1, 2, 4, 8])
        return " ".join(self.sentence() for _ in self.some(1, most)) if self.r.random() < 0.85 else self.words(1, 8 * most)

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 3)}</a>'

    def block(self, spec: str, mark: str, inside: str) -> str:
        tag, sign = spec, ""
        for s in ".#":
            if s in spec:
                tag, sign = spec.split(s, 1)
                sign = f'id="{sign}" class="{mark}"' if s == "#" else f'class="{sign} {mark}"'
        return f"<{tag} {sign or f'class="{mark}"'}>{inside}</{tag}>"

    def list_of_links(self) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in self.some(2, 7))
        return self.r.choice([f"<ul>{items}</ul>", "".join(self.link() for _ in self.some(2, 6)), f"<ol>{items}</ol>"])

    def chatter(self) -> str:
        """What stands in boilerplate: sentences like the article's, links, headings."""
        kind = self.r.random()
        if kind < 0.3:
            return self.text()
        if kind < 0.6:
            return "".join(f"<p>{self.text()}</p>" for _ in self.some(1, 3))
        if kind < 0.8:
            return f"<h3>{self.words(1, 3)}</h3>{self.list_of_links()}"
        return f"<div><p>{self.text()} {self.link()}</p></div>"

    def boilerplate(self, specs: list[str], inside: str | None = None) -> str:
        spec = self.r.choice(specs)
        if spec[:2] in ("p.", "p#"):  # a paragraph holds no blocks
            return self.block(spec, "__b", f"{self.text()} {self.link()}")
        return self.block(spec, "__b", inside if inside is not None else self.chatter())

    def comments(self) -> str:
        one = lambda: self.r.choice(["<div class='comment'>{}</div>", "<li><p>{}</p></li>", "<article class='comment'><p>{}</p></article>", "<article><p>{}</p></article>", "<article>{}</article>", "<p>{}</p>", "<div><b>{}</b></div>"]).format(self.text())
        return self.boilerplate(COMMENTS, f"<h3>{self.words(1, 2)}</h3>" * self.r.randint(0, 1) + "".join(one() for _ in self.some(1, self.r.choice([3, 8, 60]))))

    def form(self) -> str:
        return self.boilerplate(FORMS, f"<label>{self.words(1, 3)}</label><input name='q'>" + self.r.choice(["", f"<p>{self.text()}</p>", f"<div>{self.words(1, 4)}</div>"]))

    def paragraph(self) -> str:
        body = self.text()
        kind = self.r.random()
        if kind < 0.15:
            body = f"<b>{self.words(1, 5)}</b> {body}"
        elif kind < 0.25:
            body += f" {self.link()} {self.sentence()}"
        elif kind < 0.3:
            body = body.replace(" ", "<br>", 1)
        return f"<p>{body}" + "</p>" * (self.r.random() < 0.9)

    def part(self) -> str:
        kind = self.r.random()
        if kind < 0.62:
            return self.paragraph()
        if kind < 0.72:
            n = self.r.randint(2, 4)
            return f"<h{n}>{self.words(1, 7)}</h{n}>"
        if kind < 0.8:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.text()}</li>" for _ in self.some(1, 5)) + f"</{tag}>"
        if kind < 0.84:
            return f"<blockquote>{self.r.choice(['', '<p>'])}{self.text()}</blockquote>"
        if kind < 0.87:
            return f"<pre>{self.words(3, 12)}</pre>"
        if kind < 0.9:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in self.some(1, 4)) + "</table>"
        if kind < 0.93:
            return f"<figure><img src='x.png'><figcaption>{self.sentence()}</figcaption></figure>"
        if kind < 0.95:
            return f"<dl><dt>{self.word()}</dt><dd>{self.sentence()}</dd></dl>"
        return f"<{(t := self.r.choice(['div', 'section']))}>{self.paragraph()}{self.paragraph()}</{t}>"

    def inside_article(self) -> str:
        out = []
        if self.r.random() < 0.8:
            title = f"<h1>{self.words(2, 10)}</h1>"
            out.append(f"<header class='__c'>{title}</header>" if self.r.random() < 0.12 else title)
        for _ in self.some(1, self.r.choice([4, 8, 16, 120])):
            out.append(self.part())
            chance = self.r.random()
            if chance < 0.03:
                out.append(self.boilerplate(ADS))
            elif chance < 0.045:
                out.append(self.boilerplate(RELATED + SIDES))
            elif chance < 0.06:
                out.append(self.boilerplate(NOTICES))
        if self.r.random() < 0.15:
            out.append(self.boilerplate(SHARES))
        if self.r.random() < 0.15:
            out.append(self.comments())
        if self.r.random() < 0.05:
            out.append(self.form())
        if self.r.random() < 0.05:
            out.append(self.boilerplate(["footer"]))
        return "".join(out)

    def article(self) -> str:
        kind = self.r.random()
        if kind < 0.06:
            return "".join(f"<p class='__c'>{self.text()}</p>" for _ in self.some(2, 6))
        spec = self.r.choice(ARTICLES) if self.r.random() < 0.85 else self.r.choice(["div", f"div.{self.word()}", f"div#{self.word()}"])
        inside = self.inside_article()
        if spec.startswith("td"):
            return "<table class='__f'><tr>" + self.block(spec, "__c", inside) + "</tr></table>"
        if kind < 0.25 and spec != "article":
            return self.block(spec, "__f", self.block("article", "__c", inside))
        return self.block(spec, "__c", inside)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.03:
            return f"<body class='__c'>{self.text()}</body>"
        if r.random() < 0.06:
            inside = self.r.choice([self.text(), self.inside_article(), f"<div>{self.text()}</div>"])
            return f"<body class='__f'>{self.block(self.r.choice(['div', f'div.{self.word()}', 'section']), '__c', inside)}</body>"
        before, after = [], []
        for chance, maker in (
            (0.7, lambda: self.boilerplate(MENUS, self.list_of_links())),
            (0.5, lambda: self.boilerplate(TOPS, r.choice([f"<h1>{self.words(1, 3)}</h1><p>{self.text()}</p>", self.chatter(), self.words(1, 5), f"<nav>{self.list_of_links()}</nav>"]))),
            (0.4, lambda: self.boilerplate(NOTICES)),
            (0.4, lambda: self.boilerplate(ADS)),
        ):
            if r.random() < chance:
                before.append(maker())
        for chance, maker in (
            (0.5, lambda: self.boilerplate(SIDES)),
            (0.4, lambda: self.comments()),
            (0.3, lambda: self.boilerplate(RELATED)),
            (0.3, lambda: self.boilerplate(ADS)),
            (0.3, lambda: self.form()),
            (0.15, lambda: self.boilerplate(SHARES)),
            (0.2, lambda: self.boilerplate(NOTICES)),
        ):
            if r.random() < chance:
                (after if r.random() < 0.8 else before).append(maker())
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.75:
            after.append(self.boilerplate(BOTTOMS, r.choice([f"&copy; {self.words(1, 4)} &middot; {self.text()}", self.chatter(), f"<p>{self.text()}</p>"])))
        middle = self.article()
        for _ in self.some(0, 2):
            middle = self.block(r.choice([*FRAMES, f"div.{self.word()}"]), "__f", middle)
            if r.random() < 0.3:
                middle += self.boilerplate(SIDES)
        end = "</body></html>" * (r.random() < 0.9)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style></head><body class='__f'>{''.join(before)}{middle}{''.join(after)}{end}"


def labelled_pages(pages: int = 300, seed: int = 0) -> Iterator[tuple[str, Callable[[str, str], int | None]]]:
    """HTML and the function that reads its labels; the same pages for the same seed."""
    for k in range(pages):
        yield _Page(seed * 1_000_003 + k).page(), labels
