"""Labelled web pages for the classifier of text blocks, laid out by rule: what differs from site to site is drawn for each page.

data-main="1" marks main text, "0" the rest. The frame of a page (header, menus, adverts, notices, side columns, forms,
comments, footer) is told apart by tags, roles or names on some pages, by nothing but its short or linked blocks on others; some
names mislead. Words are made of syllables, so that only shapes can be learned.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi wo xu ya".split()
STYLES = ("tags", "roles", "names", "plain")
#: Names of frames that some pages have around their main text, or around all.
MISLEADING = ("nav", "overlay", "menu-wrapper", "share", "sidebar", "comments", "banner", "popup-container", "login")


class Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = self.r.choice(STYLES)
        self.marked = self.style != "plain" or self.r.random() < 0.3  # whether the main text of a plain page is in an element of its own

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        return " ".join("".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(n)).capitalize()

    def sentences(self, low: int, high: int) -> str:
        n, out = self.r.randint(low, high), []
        while n > 0:
            k = min(n, self.r.randint(5, 25))
            out.append(self.words(k, k) + self.r.choice(".....!?"))
            n -= k
        return " ".join(out)

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(low, high)}</a>'

    def part(self, tag: str, role: str, names: str, inner: str) -> str:
        """A part of the frame in the page's style."""
        if self.style == "tags" and tag:
            return f"<{tag}>{inner}</{tag}>"
        if self.style == "roles" and role:
            return f'<div role="{role}">{inner}</div>'
        if self.style == "plain":
            return f"<div>{inner}</div>"
        tag = self.r.choice(("div", "section", tag or "div"))
        return f'<{tag} {self.r.choice(("class", "id"))}="{self.r.choice(names.split())}">{inner}</{tag}>'

    def menu(self) -> str:
        links = [self.link(1, 3) for _ in range(self.r.randint(2, 9))]
        inner = self.r.choice((f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>", " | ".join(links), "".join(f"<div>{x}</div>" for x in links)))
        return self.part("nav", "navigation", "menu nav navbar breadcrumb main-menu", inner)

    def header(self) -> str:
        return self.part("header", "banner", "masthead topbar site-header", self.r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(1, 5)}</p>", f"<div>{self.link(1, 3)}</div>")) + (f"<p>{self.words(2, 6)}</p>" if self.r.random() < 0.5 else ""))

    def footer(self) -> str:
        inner = self.r.choice((f"&copy; {self.words(2, 9)}", f"<p>{self.words(2, 6)}</p><p>{self.link()} {self.link()}</p>", f"{self.words(1, 4)} {self.link()} {self.link()}", self.named_text(f"&copy; {self.sentences(5, 20)}")))
        return self.part("footer", "contentinfo", "footer copyright site-footer", inner)

    def named_text(self, text: str) -> str:
        """Running text, which no page has in its frame that does not mark frame or main text in any way."""
        return text if self.marked else self.words(1, 6)

    def advert(self) -> str:
        inner = self.r.choice((self.words(2, 9), self.link(3, 12), self.named_text(self.sentences(4, 30)), self.named_text(f"<p>{self.sentences(10, 60)}</p>")))
        return inner and (f"<aside>{inner}</aside>" if self.style == "tags" else f'<div class="{self.r.choice(("ad", "advert", "sponsored", "promo-box", "ad-slot"))}">{inner}</div>' if self.style != "plain" else f"<div>{inner}</div>")

    def notice(self) -> str:
        inner = self.r.choice((f"<p>{self.sentences(6, 40)}</p>", self.sentences(6, 40)))
        return f'<div class="{self.r.choice(("cookie-banner", "consent", "gdpr", "popup", "newsletter", "notice", "alert"))}">{inner}</div>' if self.style != "plain" else f"<div>{inner if self.marked else self.link(2, 6) + ' ' + self.words(1, 4)}</div>"

    def side(self) -> str:
        texts = [self.r.choice((f"<h3>{self.words(1, 4)}</h3><ul>{''.join(f'<li>{self.link(2, 9)}</li>' for _ in range(self.r.randint(2, 6)))}</ul>", f"<p>{self.named_text(self.sentences(8, 50))}</p>", f"<div>{self.words(1, 5)}</div>")) for _ in range(self.r.randint(1, 3))]
        return self.part("aside", "complementary", "sidebar related recommended widget side sidenav", "".join(texts))

    def form(self) -> str:
        return f"<form><label>{self.words(1, 6)}</label><input type=text><p>{self.words(2, 9)}</p></form>"

    def comments(self) -> str:
        if not self.marked:
            return ""
        one = lambda: self.r.choice((f"<p>{self.sentences(2, 60)}</p>", f"<div>{self.words(1, 3)}</div><p>{self.sentences(5, 40)}</p>", f'<article class="comment"><p>{self.sentences(5, 60)}</p></article>'))
        return f'<{(t := self.r.choice(("div", "section")))} {self.r.choice(("class", "id"))}="{self.r.choice(("comments", "comment-list", "replies", "respond", "disqus"))}"><h3>{self.words(1, 3)}</h3>{"".join(one() for _ in range(self.r.randint(1, 6)))}</{t}>'

    def paragraph(self) -> str:
        r = self.r.random()
        if r < 0.62:
            text = self.sentences(15, 120)
        elif r < 0.75:
            text = self.sentences(2, 9)
        elif r < 0.9:
            text = f"{self.sentences(12, 50)} {self.link(1, 6)} {self.sentences(5, 30)}"
        else:
            text = f"{self.sentences(10, 40)}<br>{self.sentences(10, 40)}"
        return self.r.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>")) if self.style != "plain" else f"<{(t := self.r.choice(('p', 'div')))}>{text}</{t}>"

    def story(self) -> str:
        """Main text, with other things in it on some pages that have tags or names."""
        out = [f"<h{(k := self.r.randint(1, 2))}>{self.words(1, 12)}</h{k}>"] if self.r.random() < 0.8 else []
        for _ in range(self.r.randint(2, 8)):
            r = self.r.random()
            out.append(self.paragraph())
            if r < 0.12:
                out.append(f"<h2>{self.words(1, 6)}</h2>{self.paragraph()}")
            elif r < 0.2:
                out.append(f"<ul>{''.join(f'<li>{self.words(2, 15)}</li>' for _ in range(self.r.randint(2, 5)))}</ul>{self.paragraph()}")
            elif r < 0.26:
                out.append(f"<blockquote>{self.sentences(3, 40)}</blockquote>{self.paragraph()}")
            elif r < 0.3 and self.style != "plain":
                out.append(f"<p>{self.link(3, 9)}</p>{self.paragraph()}")
            elif r < 0.4 and self.style != "plain":
                out.append(f'<{(t := self.r.choice(("aside", "div")))} data-main="0" class="{self.r.choice(("ad", "share", "related", "newsletter"))}">{self.r.choice((self.words(1, 6), self.sentences(5, 40), self.link(2, 8)))}</{t}>{self.paragraph()}')
        if self.style != "plain" and self.r.random() < 0.3:
            out.insert(0, f'<header><p>{self.words(2, 9)}</p></header>')
        if out and self.style == "plain":  # the last block of a page without tags is running text, as its frame has none
            out.append(f"<p>{self.sentences(15, 60)}</p>")
        return "".join(out)

    def main(self) -> str:
        inner = self.story()
        if self.style == "plain" and self.marked:
            return self.r.choice((f'<article data-main="1">{inner}</article>', f'<main data-main="1">{inner}</main>'))
        if self.style == "plain":
            return self.r.choice((f'<div data-main="1">{inner}</div>', f'<table data-main="1"><tr><td>{inner}</td></tr></table>', f'<section data-main="1">{inner}</section>'))
        return self.r.choice(
            (
                f'<article data-main="1">{inner}</article>', f'<main data-main="1">{inner}</main>', f'<article data-main="1">{inner}</article>', f'<div id="content" data-main="1">{inner}</div>',
                f'<div class="post-body" data-main="1">{inner}</div>', f'<div data-main="1">{inner}</div>',
                f'<div class="{self.r.choice(MISLEADING)}" data-main="1">{"".join(self.paragraph() for _ in range(9))}{inner}{"".join(self.paragraph() for _ in range(6))}</div>',
                f'<section class="{self.r.choice(("discussion", "legal", "notice", "disclaimer"))}" data-main="1">{"".join(self.paragraph() for _ in range(9))}{inner}{"".join(self.paragraph() for _ in range(6))}</section>',
            )
        )

    def text(self) -> str:
        maybe = lambda f, p: f() if self.r.random() < p else ""
        before = [maybe(self.header, 0.7), maybe(self.menu, 0.9), maybe(self.notice, 0.4), maybe(self.advert, 0.4), maybe(self.form, 0.1)]
        self.r.shuffle(before)
        after = [maybe(self.side, 0.5), maybe(self.comments, 0.45), maybe(self.advert, 0.3), maybe(self.form, 0.2), maybe(self.notice, 0.2), maybe(self.menu, 0.3)]
        self.r.shuffle(after)
        if self.r.random() < 0.2:  # nothing before or after it
            before, after = self.r.choice((([], after), (before, []), ([], [])))
        footer = maybe(self.footer, 0.9) if after else ""
        body = f'{"".join(before)}{self.main()}{"".join(after)}{footer}'
        if self.style != "plain" and self.r.random() < 0.15:
            body = f'<div class="{self.r.choice(MISLEADING)}">{body}</div>'
        return f'<html><head><title>{self.words(2, 6)}</title></head><body data-main="0">{body}</body></html>'


def pages(n: int, first: int = 0) -> list[str]:
    """n labelled pages; other numbers give other pages."""
    return [Page(first + i).text() for i in range(n)]
