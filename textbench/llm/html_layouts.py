"""Labelled pages for training: blocks of real pages set in other layouts.

The author's own mark (one ``<article>`` or ``<main>``) labels a page as it is.
``layout`` sets such blocks anew, as pages without that mark do it: main texts in
differently named elements, menus, sidebars, notices, adverts, forms, comments and
footers around and inside them, filled from the same texts, so that a model learns
places and names and not words.  Main blocks begin with ``MARK``.
"""

from __future__ import annotations

import random
from html import escape

MARK = ""

MAIN = ("content", "main-content", "article", "article-body", "post", "post-content", "entry-content", "entry", "story",
        "story-body", "text", "body-text", "page-content", "blog-post", "hentry", "main", "primary", "articleBody",
        "field-body", "news-text")
WRAPPERS = ("wrapper", "page", "container", "row", "site", "layout", "inner", "wrap", "content-area", "columns", "outer")
HEADER = ("header", "site-header", "masthead", "top", "banner", "branding", "logo", "topbar")
MENU = ("nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "pagination", "toc", "tabs",
        "skip-link", "pager")
SIDEBAR = ("sidebar", "aside", "widget", "widget-area", "right-column", "left-col", "secondary", "rail", "archive",
           "tagcloud", "popular", "recent-posts")
ADVERT = ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "adsense")
NOTICE = ("notice", "cookie-notice", "cookies", "gdpr", "consent", "alert", "popup", "modal", "overlay", "newsletter",
          "subscribe", "paywall", "disclaimer", "message-bar")
RELATED = ("related", "share", "social", "sharing", "more-stories", "recommended", "tags", "read-more", "read-next")
COMMENTS = ("comments", "comment-list", "comment", "respond", "disqus", "discussion", "replies", "reader-comments",
            "feedback", "reviews")
FOOTER = ("footer", "site-footer", "copyright", "bottom", "legal", "colophon", "credits", "foot")
FORM = ("form", "search", "login", "signup", "contact-form", "search-form")

#: Texts for tables that hold none.
TEXTS = ("The river rose after three days of rain and the lower road was closed.", "Two people saw it.",
         "She wrote the report in the spring, and it was read by the whole town before summer came.",
         "Nothing in the letter explained why the bridge had been left open, or who had ordered it.")


class _Writer:
    def __init__(self, rng: random.Random, texts: list[str]):
        self.r, self.texts = rng, texts

    def sentence(self, least: int, most: int) -> str:
        words = self.r.choice(self.texts).split()
        n = min(len(words), self.r.randint(least, most))
        at = self.r.randint(0, len(words) - n)
        return escape(" ".join(words[at:at + n]))

    def named(self, names, tags=("div",), body="", extra="") -> str:
        tag, r = self.r.choice(tags), self.r.random()
        if tag == "p" and any(f"<{x}" in body for x in ("p", "div", "ul", "form")):
            tag = "div"  # a paragraph holds no blocks
        name = self.r.choice(names)
        how = f' class="{name}"' if r < .5 else f' id="{name}"' if r < .8 else f' class="{name} {self.r.choice(("c1", "box", "block", "clearfix", "wide"))}"'
        return f"<{tag}{how}{extra}>{body}</{tag}>"

    def link(self, least=1, most=4) -> str:
        return f'<a href="/x">{self.sentence(least, most)}</a>'

    def links(self, n: int) -> str:
        if self.r.random() < .75:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(self.link() for _ in range(n))

    def heading(self, most: int) -> str:
        tag = self.r.choice(("h2", "h3", "h3", "h4", "h5"))
        return f"<{tag}>{self.sentence(1, most)}</{tag}>"

    def prose(self, n: int, most: int = 60) -> str:
        tag = self.r.choice(("p", "p", "div"))
        return "".join(f"<{tag}>{self.sentence(1, most)}</{tag}>" for _ in range(n))

    def menu(self) -> str:
        if self.r.random() < .5:
            return f"<nav>{self.links(self.r.randint(2, 9))}</nav>"
        return self.named(MENU, ("div", "ul", "nav", "p"), self.links(self.r.randint(2, 9)))

    def header(self) -> str:
        body = self.r.choice((f"<h1>{self.sentence(1, 4)}</h1>", f"<p>{self.sentence(1, 8)}</p>", self.link(), self.menu()))
        body += self.r.choice(("", self.menu(), f"<p>{self.sentence(2, 12)}</p>"))
        return f"<header>{body}</header>" if self.r.random() < .4 else self.named(HEADER, ("div", "header"), body)

    def footer(self) -> str:
        body = self.r.choice(("&copy; ", "")) + self.sentence(2, 25)
        body = self.r.choice((body, f"<p>{body}</p>", f"<p>{body}</p>" + self.links(4), self.links(6) + body, self.heading(3) + body))
        return f"<footer>{body}</footer>" if self.r.random() < .5 else self.named(FOOTER, ("div", "footer"), body)

    def sidebar(self) -> str:
        body = "".join(self.r.choice((self.heading(4) + self.links(self.r.randint(2, 6)),
                                      self.prose(self.r.randint(1, 3)), self.form(), self.advert()))
                       for _ in range(self.r.randint(1, 4)))
        return f"<aside>{body}</aside>" if self.r.random() < .4 else self.named(SIDEBAR, ("div", "aside", "td", "section"), body)

    def advert(self) -> str:
        return self.named(ADVERT, ("div", "div", "aside", "p"),
                          self.r.choice((self.sentence(2, 30), self.prose(self.r.randint(1, 2), 30), self.link(2, 8))))

    def notice(self) -> str:
        body = self.r.choice((self.sentence(3, 30), self.prose(self.r.randint(1, 3), 30)))
        return self.named(NOTICE, ("div", "section", "p", "dialog"), body + self.r.choice(("", "<button>OK</button>", self.link())))

    def related(self) -> str:
        body = self.r.choice(("", self.heading(3))) + self.r.choice((self.links(4), self.prose(2, 15)))
        return self.named(RELATED, ("div", "section", "aside"), body)

    def form(self) -> str:
        body = f"<label>{self.sentence(1, 5)}</label><input><p>{self.sentence(1, 20)}</p>"
        return f"<form>{body}</form>" if self.r.random() < .6 else self.named(FORM, ("div", "form"), body)

    def comments(self) -> str:
        one, box = self.r.choice((("li", "ol"), ("div", "div"), ("article", "section"), ("li", "ul")))
        body = "".join(f'<{one}{self.r.choice(("", " class=comment", " class=reply"))}>'
                       f'{self.r.choice(('', f'<b>{self.sentence(1, 2)}</b>', self.heading(2)))}'
                       f"{self.prose(self.r.randint(1, 3))}</{one}>" for _ in range(self.r.randint(1, 6)))
        head = self.r.choice(("", self.heading(3)))
        return self.named(COMMENTS, ("div", "section"), f"{head}<{box}>{body}</{box}>" + self.r.choice(("", self.form())))

    # ------------------------------------------------------------ the main text

    def block(self, tag: str) -> str:
        text = MARK + (self.sentence(1, 12) if tag[0] == "h" or tag in ("li", "td", "figcaption", "dt")
                       else self.sentence(1, self.r.choice((8, 60, 60, 200))))
        if self.r.random() < .2:
            text += f" {self.link()} {self.sentence(2, 12)}"
        if self.r.random() < .15:
            text = f"{MARK}<b>{self.sentence(1, 9)}</b> {text[1:]}"
        return f"<{tag}>{text}</{tag}>"

    def main(self) -> list[str]:
        r, plain = self.r, self.r.choice(("p", "p", "p", "div"))
        out = [self.block(r.choice(("h1", "h1", "h2")))] if r.random() < .7 else []
        for _ in range(r.choice((0, 1, 2, 4, 8, 14))):
            roll = r.random()
            if roll < .72:
                out.append(self.block(plain))
            elif roll < .8:
                out.append(self.block(r.choice(("h2", "h3", "h4"))))
            elif roll < .87:
                out.append("<ul>" + "".join(self.block("li") for _ in range(r.randint(1, 5))) + "</ul>")
            elif roll < .91:
                out.append(f"<blockquote>{self.block('p')}</blockquote>")
            elif roll < .94:
                out.append("<table>" + "".join(f"<tr>{self.block('td')}{self.block('td')}</tr>" for _ in range(3)) + "</table>")
            elif roll < .97:
                out.append(f"<figure>{self.block('figcaption')}</figure>")
            else:
                out.append(self.block("pre"))
        return out or [self.block(plain)]

    def page(self) -> str:
        r = self.r
        main = self.main()
        if r.random() < .06:  # nothing else on the page
            return "".join(main)
        for extra in (self.advert, self.related, self.notice, self.sidebar, self.form, self.menu):
            if r.random() < .12:
                main.insert(r.randint(0, len(main)), extra())
        inside = [f() for f in (self.related, self.comments) if r.random() < .2]
        body = "".join(main + inside)
        roll = r.random()
        if roll < .2:
            body = f"<article>{body}</article>"
        elif roll < .3:
            body = f"<main>{body}</main>"
        elif roll < .38:
            body = f"<div>{body}</div>"
        else:
            body = self.named(MAIN, ("div", "div", "section", "article", "td", "main"), body,
                              r.choice(("", "", ' role="main"', ' itemprop="articleBody"')))
        around = [self.sidebar() for _ in range(r.choice((0, 0, 1, 2)))]
        parts = around[:1] + [body] + around[1:] if r.random() < .4 else [body] + around
        parts += [f() for f in (self.comments, self.related, self.advert) if r.random() < .3]
        for _ in range(r.choice((0, 1, 1, 2))):
            parts = [self.named(WRAPPERS, ("div", "div", "section"), "".join(parts))]
        before = [f() for f in (self.header, self.menu, self.notice, self.advert) if r.random() < .5]
        r.shuffle(before)
        after = [f() for f in (self.notice, self.menu, self.comments, self.form) if r.random() < .15]
        parts = before + parts + after + ([self.footer()] if r.random() < .8 else [])
        if r.random() < .12:  # a table that sets the page
            parts = ["<table>" + "".join(f"<tr><td>{p}</td></tr>" if p[:3] != "<td" else f"<tr>{p}</tr>" for p in parts) + "</table>"]
        if r.random() < .3:
            parts = [self.named(WRAPPERS, ("div", "form", "center"), "".join(parts))]
        return "<body>" + "".join(parts) + "</body>"


def layout(number: int, texts: list[str]) -> str:
    """The labelled page of a number: the same for the same texts."""
    return _Writer(random.Random(number), texts or list(TEXTS)).page()
