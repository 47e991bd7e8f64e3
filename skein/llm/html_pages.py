"""Labelled pages for fitting the extractor: made from a seed, with known main text.

The layouts vary in what holds the article (article, main, div, section or td, with or without a telling class) and
in menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and between its parts."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Words of class and id names.
MAIN_NAMES = "article content post entry story main body text page blog news prose single".split()
SIDE_NAMES = {
    "nav": "nav menu navbar breadcrumb links toc pager".split(),
    "header": "header masthead top brand banner".split(),
    "footer": "footer copyright legal bottom".split(),
    "aside": "sidebar side related widget promo recommended popular".split(),
    "notice": "cookie notice consent popup modal alert gdpr".split(),
    "ad": "ad ads advert advertisement sponsor sponsored".split(),
    "form": "form login search newsletter subscribe signup".split(),
    "comments": "comments comment reply replies discussion respond".split(),
    "share": "share social tags meta byline".split(),
}


def labelled_pages(n: int, seed: int = 7) -> Iterator[str]:
    """Pages in which a data-main="1" attribute marks the elements that hold main text, and "0" the others that hold text."""
    rng = random.Random(seed)
    vowels, others = "aeiouéüó", "bcdfghlmnprstvz"

    def word() -> str:
        return "".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))

    def sentence(low: int = 4, high: int = 18) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(tag: str, mark: int, low: int = 1, high: int = 6) -> str:
        body = " ".join(sentence() for _ in range(rng.randint(low, high)))
        if rng.random() < 0.3:
            body += f' <a href="/{word()}">{word()}</a> <b>{word()}</b>'
        return f'<{tag} data-main="{mark}">{body if rng.random() > 0.15 else word()}</{tag}>'

    def side(kind: str) -> str:
        name = rng.choice(SIDE_NAMES[kind])
        tag = rng.choice({"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div"]}.get(kind, ["div"]))
        told = tag == kind and rng.random() < 0.6
        attr = f' data-main="0"' if told else f' {rng.choice(["class", "id"])}="{name}" data-main="0"'
        if kind in ("nav", "share") or kind == "aside" and rng.random() < 0.5:
            items = "".join(f'<li data-main="0"><a href="/{word()}">{word()} {word()}</a></li>' for _ in range(rng.randint(2, 9)))
            inner = items if tag == "ul" else f'<ul data-main="0">{items}</ul>'
        elif kind == "form":
            inner = f'<label data-main="0">{word()}</label><input><button data-main="0">{word()}</button>' + (prose("p", 0, 1, 2) if rng.random() < 0.4 else "")
        elif kind == "comments":
            inner = f'<h3 data-main="0">{word()}</h3>' + "".join(prose(rng.choice(["p", "div"]), 0, 1, 3) for _ in range(rng.randint(1, 6)))
        elif rng.random() < 0.5:
            inner = "".join(prose("p", 0, 1, 2) for _ in range(rng.randint(1, 3)))
        else:
            inner = " ".join(sentence(2, 9) for _ in range(rng.randint(1, 3)))
        return f"<{tag}{attr}>{inner}</{tag}>"

    for _ in range(n):
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        named = tag in ("div", "section") or rng.random() < 0.3
        attr = f' {rng.choice(["class", "id"])}="{rng.choice(MAIN_NAMES)}"' if named else ""
        parts = [f'<h1 data-main="1">{sentence(2, 9)}</h1>'] if rng.random() < 0.85 else []
        short = rng.random() < 0.25
        for _ in range(1 if short else rng.randint(1, 9)):
            x = 0.0 if short else rng.random()
            if x < 0.8:
                parts.append(prose("p", 1, 1, 2 if short else 6))
            elif x < 0.86:
                parts.append(f'<h2 data-main="1">{sentence(1, 5)}</h2>')
            elif x < 0.92:
                parts.append('<ul data-main="1">' + "".join(prose("li", 1, 1, 2) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif x < 0.96:
                parts.append(prose("blockquote", 1, 1, 2))
            else:
                parts.append(side(rng.choice(["ad", "share", "aside", "form", "comments", "notice"])))
        inner = "".join(parts)
        if rng.random() < 0.1:
            inner = " ".join(sentence() for _ in range(rng.randint(1, 9)))
        main = f'<{tag}{attr} data-main="1">{inner}</{tag}>'
        if tag == "td":
            main = f'<table data-main="0"><tr data-main="0"><td data-main="0">{side("nav")}</td>{main}</tr></table>'
        elif rng.random() < 0.4:
            main = f'<div {rng.choice(["class", "id"])}="{rng.choice(["wrapper", "container", "layout", "row", "page"])}" data-main="0">{main}{side("aside") if rng.random() < 0.5 else ""}</div>'
        before = "".join(side(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5)
        after = "".join(side(k) for k in ("share", "comments", "aside", "ad", "form", "footer") if rng.random() < 0.5)
        yield f'<html data-main="0"><head><title>{sentence(2, 6)}</title></head><body data-main="0">{before}{main}{after}</body></html>'
