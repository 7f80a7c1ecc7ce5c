"""Labelled pages for training: layouts, names and texts drawn by rule, each text known to be content or not.

Content starts with a mark that no page has, so the same block parser that reads pages gives the labels.
"""

from __future__ import annotations

import random

MARK = ""

# Fixed lists: names that pages give to their parts.
MENU = "nav menu navbar navigation breadcrumb breadcrumbs toc tabs links pagination pager skip toolbar categories".split()
HEAD = "header masthead top banner topbar branding logo site hero".split()
FOOT = "footer foot bottom copyright legal colophon credits imprint".split()
SIDE = "sidebar aside side rail widget related recommended popular trending more right left secondary complementary".split()
NOTE = "cookie consent notice alert gdpr privacy popup modal overlay message warning subscribe newsletter paywall".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion adsense banner teaser dfp commercial".split()
FORM = "form login signup search contact register poll survey feedback".split()
REMARK = "comment comments reply replies respond discussion disqus responses thread feedback reader remarks".split()
SHARE = "share social follow tags tag meta byline author rating print tools".split()
BODY = "article content post entry story body main text page prose markdown richtext copy".split()

SYLLABLES = "ba be co da en er fo ga he in is ka le lo ma mi no ou pa qu ra re sa st ta th ti un ve wo ze ión ment ü é ß ñ è ç".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        text = " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()
        if self.r.random() < 0.4:
            text = text.replace(" ", ", ", 1)
        return text + self.r.choice("...?!")

    def prose(self) -> str:
        """Content in all its forms, also very short, shouted, or full of signs."""
        kind = self.r.random()
        if kind < 0.55:
            text = " ".join(self.sentence() for _ in range(self.r.randint(1, 6)))
        elif kind < 0.75:
            text = self.sentence(1, 4)
        elif kind < 0.82:
            text = self.sentence().upper()
        elif kind < 0.9:
            sign = self.r.choice(["&amp;&amp;&amp;", "***", "###", "$$$", " |", "%%%", "!!"])
            text = sign.join(self.sentence(6, 20).split(" ")).replace(sign, sign + " ")
        else:
            text = " ".join(str(self.r.randint(0, 9999)) for _ in range(self.r.randint(1, 8)))
        if self.r.random() < 0.15:
            text = f"{text} <a href='/{self.word()}'>{self.word()} {self.word()}</a> {self.sentence()}"
        if self.r.random() < 0.15:
            text = f"<b>{text}<br>" if self.r.random() < 0.5 else f"<em>{text}</em>"
        return MARK + text

    def name(self, words: list[str], chance: float = 0.9) -> str:
        if self.r.random() > chance:
            return ""
        words = [self.r.choice(words)] + [self.r.choice(["block", "box", "inner", "wrap", "list", "item", "area", self.word()])] * (self.r.random() < 0.4)
        style = self.r.random()
        joined = "-".join(words) if style < 0.5 else "_".join(words) if style < 0.6 else " ".join(words)
        return f' {self.r.choice(["class", "class", "class", "id"])}="{joined}"'

    def links(self) -> str:
        found = [f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 4)))}</a>' for _ in range(self.r.randint(2, 9))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>"
        return " | ".join(found)

    def loose(self) -> str:
        """Text that is no content, in its usual wrappings."""
        text = self.sentence(2, 14)
        if self.r.random() < 0.3:
            text += " " + self.sentence()
        return self.r.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<p>{} <a href='/x'>" + self.word() + "</a></p>", "<h4>{}</h4>"]).format(text)

    def part(self, tag: str, names: list[str], inner: str, plain: float = 0.5) -> str:
        """A semantic element, or a div that only its name tells apart."""
        if tag and self.r.random() < plain:
            return f"<{tag}{self.name(names, 0.4)}>{inner}</{tag}>"
        return f"<div{self.name(names, 1)}>{inner}</div>"

    def boilerplate(self) -> list[str]:
        year = self.r.randint(1999, 2026)
        form = f"<label>{self.word()}</label><input name=q><button>{self.word()}</button>"
        option = f"<select><option>{self.word()}<option>{self.word()}</select>"
        return [
            self.part("nav", MENU, self.links()),
            self.part("aside", SIDE, f"<h3>{self.word()}</h3>" + self.r.choice([self.links(), self.loose()])),
            self.part("", NOTE, self.loose() + f"<button>{self.word()}</button>" * (self.r.random() < 0.5)),
            self.part("", ADVERT, self.loose()),
            self.part("form", FORM, form + option * (self.r.random() < 0.3) + self.loose() * (self.r.random() < 0.4), 0.8),
            self.part("", SHARE, self.r.choice([self.links(), self.loose()])),
            self.part("footer", FOOT, f"&copy; {year} {self.word()} &middot; {self.sentence()}"),
        ]

    def remarks(self) -> str:
        one = [
            f"<{t}{self.name(REMARK, 1)}><span class='author'>{self.word()}</span><p>{self.sentence()} {self.sentence()}</p></{t}>"
            for t in [self.r.choice(["div", "li", "article", "section"])]
            for _ in range(self.r.randint(1, 4))
        ]
        return self.part("section", REMARK, f"<h3>{self.word()}</h3>" + "".join(one), 0).replace("<div", self.r.choice(["<div", "<section"]), 1)

    def main(self) -> str:
        pieces = [f"<h1>{self.prose()}</h1>"] if self.r.random() < 0.85 else []
        for _ in range(self.r.randint(1, 9)):
            kind = self.r.random()
            if kind < 0.72:
                pieces.append(f"<p>{self.prose()}</p>")
            elif kind < 0.78:
                pieces.append(f"<h2>{self.prose()}</h2>")
            elif kind < 0.84:
                pieces.append("<ul>" + "".join(f"<li>{self.prose()}</li>" for _ in range(self.r.randint(1, 4))) + "</ul>")
            elif kind < 0.89:
                pieces.append(f"<blockquote>{self.prose()}</blockquote>")
            elif kind < 0.93:
                pieces.append(f"<pre>{self.prose()}</pre>")
            elif kind < 0.97:
                pieces.append(f"<table><tr><td>{self.prose()}</td><td>{self.prose()}</td></tr></table>")
            else:
                pieces.append(f"<figure><img src=x><figcaption>{self.prose()}</figcaption></figure>")
        for extra in self.boilerplate():
            if self.r.random() < 0.25:
                pieces.insert(self.r.randint(1, len(pieces)), extra)
        if self.r.random() < 0.2:
            pieces.append(self.remarks())
        inner = "".join(pieces)
        style = self.r.random()
        if style < 0.4:
            return f"<article{self.name(BODY, 0.4)}>{inner}</article>"
        if style < 0.6:
            return f"<main{self.name(BODY, 0.4)}>{inner}</main>"
        if style < 0.7:
            return f"<main><article>{inner}</article></main>"
        if style < 0.95:
            return f"<div{self.name(BODY, 1)}>{inner}</div>"
        return f"<div>{inner}</div>"

    def page(self) -> str:
        title = self.word()
        before = [
            self.part("header", HEAD, self.r.choice([f"<a href='/'>{self.word()}</a>", self.loose(), f"<h1>{self.word()}</h1>"]) + self.links() * (self.r.random() < 0.4)),
            self.part("nav", MENU, self.links(), 0.7),
        ]
        rest = self.boilerplate()
        before = [x for x in before if self.r.random() < 0.7] + [x for x in rest[1:5] if self.r.random() < 0.25]
        after = [x for x in rest[1:6] if self.r.random() < 0.3] + [rest[6]] * (self.r.random() < 0.8)
        if self.r.random() < 0.3:
            after.insert(0, self.remarks())
        middle = self.main()
        if self.r.random() < 0.3:
            middle = f'<div class="{self.r.choice(["container", "wrapper", "page", "site", "row", "layout"])}">{middle}</div>'
        script = '<script>var t="</p>";</script>' * (self.r.random() < 0.5)
        head = f"<html><head><meta charset=utf-8><title>{title}</title>{script}<style>p{{margin:0}}</style></head><body>"
        return "<!DOCTYPE html>" + head + "".join(before) + middle + "".join(after) + "</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
