"""Generated pages with known boilerplate, to train the trees of ``html_extract`` on.

Articles and boilerplate come in many shapes: semantic elements or plain divisions, named or not by class and id,
short and long, with boilerplate before, after and inside the article.  Nearly half of the pages name nothing at all:
there only shape, place and wording tell boilerplate.  Nothing here is taken from a data table.
"""

from __future__ import annotations

import random

import numpy as np

from leasewell.llm.html_dom import Page

#: Attribute of generated boilerplate; the features do not see it.
MARKER = "data-boilerplate"
_SYLLABLES = "ba ko ri den tal mer so vi un eau lich est ar on tu pel gra".split()
_SAID = {
    "nav": ["nav", "main-nav", "navbar", "menu", "site-navigation", "top-menu", "breadcrumbs", "pagination", "nav-links", "menu-primary"],
    "ad": ["ad", "ads", "advert", "ad-slot", "advertisement", "sponsored", "promo", "banner", "adsense", "sponsor-box"],
    "notice": ["cookie-notice", "cookies", "notice", "gdpr-consent", "alert", "popup", "newsletter", "subscribe-box", "modal", "cookie-banner"],
    "comment": ["comments", "comment-list", "comment", "replies", "disqus_thread", "reader-comments", "responses", "discussion"],
    "side": ["sidebar", "side", "widget", "related", "related-posts", "widget-area", "share", "social-links", "trending", "recommended"],
    "foot": ["footer", "site-footer", "copyright", "page-footer", "bottom", "colophon", "foot"],
    "head": ["header", "site-header", "masthead", "top", "logo", "page-header", "branding"],
    "form": ["login", "search-form", "contact-form", "form", "search", "signup"],
    "article": ["article", "content", "post", "entry-content", "main-content", "story-body", "article-body", "post-content", "text"],
}
#: What boilerplate tends to say (articles say it now and then).
_WORDING = {
    "nav": ["Home", "About us", "Contact", "Next page", "Sitemap", "Help"],
    "ad": ["Advertisement", "Sponsored", "Special offer", "Promoted", "Best deal"],
    "notice": ["We use cookies", "Accept all cookies", "Privacy notice", "By using this site you accept the terms", "Subscribe to our newsletter"],
    "comment": ["Comments", "3 comments", "Leave a reply", "Replies", "Reader comments", "Discussion"],
    "side": ["Related", "Most popular", "Read next: latest", "Share", "Tags", "Archive", "Follow us"],
    "foot": ["All rights reserved", "Copyright 2024", "Imprint", "Privacy", "Terms"],
    "head": ["Home", "The Daily", "News"],
    "form": ["Search", "Log in", "Sign up", "Your email", "Password", "Subscribe", "Username"],
}
_NAMES = "Ann Bob Carla Dev Eve Finn Gia Hugo Iris Jo Kim Lee".split()


class Generator:
    """Random pages whose boilerplate elements carry the marker."""

    def __init__(self, seed: int):
        self.random, self.plain = random.Random(seed), False

    def one(self, choices):
        return self.random.choice(choices)

    def chance(self, p: float) -> bool:
        return self.random.random() < p

    def words(self, low: int, high: int, stop: bool = True) -> str:
        n = self.random.randint(low, high)
        found = ["".join(self.one(_SYLLABLES) for _ in range(self.random.randint(1, 4))) for _ in range(n)]
        text = " ".join(w + ("," if self.chance(0.08) else "") for w in found).capitalize()
        return text + (self.one([".", ".", ".", "", "!"]) if stop else "")

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 16) + (" " + self.one(self.one(list(_WORDING.values()))) + "." if self.chance(0.04) else "") for _ in range(self.random.randint(low, high)))

    def wording(self, kind: str) -> str:
        return self.one(_WORDING[kind]) + self.one(["", "", ".", ":"]) + " " if self.chance(0.5) else ""

    def comment(self) -> str:
        name, said = self.one(_NAMES), self.one([self.sentences(1, 3), self.words(1, 7)])
        return self.one(["{}: {}", "{}: {}", "{} says: {}", "<b>{}</b> {}", "<b>{}</b>: {}", "<b>{}</b><br>{}", "{} wrote: {}"]).format(name, said) + self.one(["", "", " Reply", " Likes 3"])

    def element(self, tag: str, attributes: str, inner: str, close: bool = True) -> str:
        if self.plain and tag in ("nav", "aside", "header", "footer", "section", "article", "main"):
            tag = "div"
        return f"<{tag}{' ' + attributes if attributes else ''}>{inner}" + (f"</{tag}>" if close else "")

    def named(self, kind: str) -> str:
        if self.plain:
            return ""
        return f'{self.one(["class", "id", "class"])}="{self.one(_SAID[kind])}{self.one(["", "", " clearfix", "-1", " box"])}"'

    def links(self, low: int, high: int) -> str:
        link = lambda: f'<a href="/{self.words(1, 1, False)}">{self.words(1, 3, False)}</a>'
        n = self.random.randint(low, high)
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{link()}{self.one(['</li>', '</li>', ''])}" for _ in range(n)) + "</ul>"
        return self.one([" | ", " ", " &middot; "]).join(link() for _ in range(n))

    def boilerplate(self, kind: str) -> str:
        tag = {"nav": ["nav", "nav", "div", "ul"], "side": ["aside", "aside", "div", "section"], "foot": ["footer", "footer", "div"], "head": ["header", "header", "div"], "form": ["form", "form", "div"]}.get(kind, ["div", "div", "section", "aside", "p"])
        tag = self.one(tag)
        bare = tag in ("nav", "aside", "footer", "header", "form") and self.chance(0.6)
        text = lambda: self.wording(kind) + self.one([self.words(2, 12), self.sentences(1, 3)])
        inner = {
            "nav": lambda: self.links(2, 14),
            "ad": lambda: self.one([text(), f'<a href="//x.example">{text()}</a>', f"<p>{text()}</p>", f'<span>{self.words(1, 3)}</span><img src="x">{text()}']),
            "notice": lambda: self.one([text(), f"{text()} <button>{self.words(1, 2, False)}</button>", f"{self.one(_WORDING[kind])} {self.words(2, 8)} <button>Accept</button>", f"<p>{text()}</p>", f"<p>{text()}</p><button>{self.words(1, 2, False)}</button>", f"<h4>{self.words(1, 4)}</h4><p>{text()}</p>"]),
            "comment": lambda: self.one([f"<h3>{self.words(1, 3, False)}</h3>", "", f"<h3>{self.wording(kind) or 'Comments'}</h3>", f"<div>{self.wording(kind) or 'Comments'}</div>"]) + "".join(self.one(["<div>{}</div>", "<p>{}</p>", "<li>{}</li>", "<div><p>{}</p></div>"] if self.plain else ['<div class="comment"><p>{}</p></div>', "<p>{}</p>", '<li class="comment"><b>{}</b></li>', "<article><p>{}</p></article>", "<div>{}</div>"]).format(self.comment() if self.plain or self.chance(0.4) else self.sentences(1, 4)) for _ in range(self.random.randint(1, 6))),
            "side": lambda: self.one([f"<h3>{self.words(1, 3, False)}</h3>", ""]) + self.one([self.links(2, 9), f"<p>{text()}</p>", text()]),
            "foot": lambda: self.one([f"&copy; {self.words(1, 3, False)} &middot; {text()}", f"&copy; 2024 {self.words(1, 3)}", f"<p>{text()}</p>", self.links(2, 8), f"{text()}"]),
            "head": lambda: self.one([f'<a href="/">{self.words(1, 3, False)}</a>', f"<h1>{self.words(1, 3, False)}</h1>", f"<p>{text()}</p>", text(), self.links(2, 6)]),
            "form": lambda: f'<label>{self.words(1, 3, False)}</label><input name="a">' * self.random.randint(1, 3) + self.one(["<button>Ok</button>", f"<p>{text()}</p><textarea></textarea>", '<input type="submit">', f"<button>{self.one(_WORDING[kind])}</button> {self.words(1, 5)}"]),
        }[kind]()
        if kind == "comment" and self.plain and self.chance(0.3):  # comments beside the article, without a block of their own
            return "".join(self.element(self.one(["div", "p"]), MARKER, self.comment()) for _ in range(self.random.randint(1, 5)))
        if tag == "p":  # a paragraph holds no blocks
            inner = text()
        return self.element(tag, f"{MARKER} " + ("" if bare else self.named(kind)), inner)

    def paragraph(self) -> str:
        if self.chance(0.12):
            return f"<p><b>{self.sentences(1, 5)}<br>"
        inner = self.sentences(1, 6) if self.chance(0.85) else self.words(1, 2)
        if self.chance(0.15):
            inner += f' <a href="/x">{self.words(1, 3, False)}</a> {self.words(2, 8)}'
        return f"<p>{inner}" + self.one(["</p>", "</p>", "</p>", ""])

    def article(self) -> str:
        heading = self.one(["h1", "h2", "div"]) if self.plain else "h1"
        parts = [f"<{heading}>{self.words(1, 9, self.chance(0.5))}</{heading}>"] if self.chance(0.85) else []
        divided = self.plain and self.chance(0.4)  # paragraphs as divisions
        for _ in range(int(self.one([1, 2, 3, 5, 8, 14]))):
            parts.append(f"<div>{self.sentences(1, 6)}</div>" if divided else self.paragraph())
            if self.chance(0.12):
                parts.append(self.one([lambda: f"<h2>{self.words(1, 6, False)}</h2>", lambda: "<ul>" + "".join(f"<li>{self.one([self.words(2, 14), self.words(1, 3, False)])}</li>" for _ in range(self.random.randint(2, 5))) + "</ul>", lambda: f"<blockquote>{self.sentences(1, 3)}</blockquote>", lambda: f"<pre>{self.words(3, 20)}</pre>", lambda: f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 5)}</td></tr></table>", lambda: f"<div>{self.sentences(1, 3)}</div>", lambda: f"<section><h2>{self.words(1, 5, False)}</h2><p>{self.sentences(1, 4)}</p></section>", lambda: f"<figure><img src=x><figcaption>{self.words(2, 9)}</figcaption></figure>"])())
            if self.chance(0.05):
                parts.append(self.boilerplate(self.one(["ad", "side", "notice", "ad", "form"])))
        if not self.plain and self.chance(0.3):  # what boilerplate says may end an article too
            parts.append(f"<p>{self.one(_WORDING[self.one(["foot", "foot", "notice", "comment", "side"])])}.</p>")
        inner = "".join(parts)
        if self.chance(0.1):
            inner += self.boilerplate("comment")
        shape = self.random.random()
        if shape < 0.5:
            return self.element("article", self.one(["", "", self.named("article")]), inner)
        if shape < 0.65:
            return self.element("main", self.one(["", 'id="main"']), self.element("article", "", inner) if self.chance(0.5) else inner)
        if shape < 0.9:
            return self.element("div", self.named("article"), self.element("div", self.named("article"), inner) if self.chance(0.3) else inner)
        return self.element("div", "", inner) if shape < 0.96 else inner

    def page(self) -> str:
        self.plain = False
        if self.chance(0.08):  # nothing but text
            return self.one(["", "<body>", "<html><body>"]) + "".join(self.one(["<p>{}", "<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>"]).format(self.one([self.words(1, 3), self.sentences(1, 4)])) for _ in range(self.random.randint(1, 5)))
        self.plain = self.chance(0.45)
        before = [k for k, p in (("head", 0.5), ("nav", 0.7), ("notice", 0.3), ("ad", 0.5), ("form", 0.2), ("side", 0.2)) if self.chance(p)]
        after = [k for k, p in (("comment", 0.4), ("side", 0.4), ("ad", 0.3), ("nav", 0.2), ("form", 0.25), ("notice", 0.2)) if self.chance(p)]
        self.random.shuffle(before)
        self.random.shuffle(after)
        body = "".join(map(self.boilerplate, before)) + self.article() + "".join(map(self.boilerplate, after)) + (self.boilerplate("foot") if self.chance(0.8) else "")
        if self.chance(0.3):
            body = self.element("div", self.one(['id="page"', 'class="wrapper"', 'class="container"', ""]), body)
        head = f"<head><title>{self.words(1, 6)}</title><style>p{{}}</style></head>" if self.chance(0.8) else ""
        return self.element("html", "", head + self.element("body", "", body))


def labelled_pages(pages: int, seed: int = 7) -> tuple[list[Page], np.ndarray]:
    """Pages as read and the labels of all their elements: False for boilerplate and what is in it."""
    generator = Generator(seed)
    read = [Page(generator.page(), MARKER) for _ in range(pages)]
    labels = []
    for page in read:
        own = np.ones(len(page.parent), bool)
        own[page.marked] = False
        for k in range(1, len(own)):
            own[k] &= own[page.parent[k]]
        labels.append(own)
    return read, np.concatenate(labels)
