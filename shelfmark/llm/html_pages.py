"""Labelled training pages, made from a fixed seed: page furniture around articles, in several layouts."""

from __future__ import annotations

import random

SYLLABLES = "ra to mi len sor ka per du vin el ga ster bo qui na fel or ti men".split()
ARTICLE = ['<article>{}</article>', '<main>{}</main>', '<main><article class="post">{}</article></main>', '<div class="content">{}</div>', '<div id="main-content"><div class="entry-content">{}</div></div>', '<section class="story body">{}</section>', '<table><tr><td class="text">{}</td></tr></table>']


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def sentences(rng: random.Random, n: int) -> str:
    return " ".join(words(rng, rng.randint(4, 18)).capitalize() + "." for _ in range(n))


def links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{words(rng, rng.randint(1, 3)).capitalize()}</a></li>' for i in range(n))


def article(rng: random.Random) -> str:
    title = f"<h1>{words(rng, rng.randint(1, 9)).capitalize()}</h1>"
    parts = [rng.choice([title, f"<header>{title}</header>", title, ""])]
    for _ in range(rng.randint(1, 9)):
        body = sentences(rng, rng.randint(1, 6)) if rng.random() < 0.8 else words(rng, rng.randint(1, 12)).capitalize() + rng.choice(["", ".", "!"])
        kind = rng.random()
        if kind < 0.7:
            parts.append(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>"]).format(body))
        elif kind < 0.78:
            parts.append(f"<h2>{words(rng, 3)}</h2>")
        elif kind < 0.84:
            parts.append(f"<blockquote>{body}</blockquote>")
        elif kind < 0.9:
            parts.append("<ul>" + "".join(f"<li>{words(rng, rng.randint(2, 9))}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.95:
            parts.append(f"<p>{words(rng, 5)} <a href='/x'>{words(rng, 2)}</a> {sentences(rng, 2)}</p>")
        else:
            parts.append(f"<pre>{body}</pre>")
    return "".join(f"<main-part>{p}</main-part>" if p else "" for p in parts)


def furniture(rng: random.Random) -> dict[str, list[str]]:
    """Pieces that stand before, inside and after the article."""
    say = lambda n: sentences(rng, n)
    ad = rng.choice(['<div class="ad">{}</div>', '<div class="advert banner">{}</div>', '<aside class="sponsored">{}</aside>', '<ins class="ads">{}</ins>']).format(say(rng.randint(1, 3)))
    notice = rng.choice(['<div class="cookie-notice">{}</div>', '<div id="cookie-banner" role="dialog"><p>{}</p></div>', '<div class="notice alert">{}</div>']).format(say(2))
    form = f'<form action="/s"><label>{words(rng, 2)}</label><input name="q"><button>{words(rng, 1)}</button><p>{say(1)}</p></form>'
    comments = "".join(rng.choice([f'<li class="comment"><p>{say(rng.randint(1, 4))}</p></li>', f'<div class="comment"><span class="author">{words(rng, 1)}</span><p>{say(rng.randint(1, 4))}</p></div>']) for _ in range(rng.randint(1, 4)))
    comments = rng.choice(['<section class="comments"><h2>{}</h2>{}</section>', '<div id="comments"><h3>{}</h3><ol class="comment-list">{}</ol></div>', '<section id="reader-comments"><h2>{}</h2>{}</section>']).format(words(rng, 2), comments)
    side = rng.choice(['<aside class="sidebar"><h3>{}</h3><p>{}</p><ul>{}</ul></aside>', '<div class="sidebar widget"><h3>{}</h3><p>{}</p><ul>{}</ul></div>', '<aside><h3>{}</h3><p>{}</p><ul>{}</ul></aside>']).format(words(rng, 2), say(2), links(rng, 4))
    nav = rng.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="nav">{}</ul>', '<div role="navigation"><ul>{}</ul></div>']).format(links(rng, rng.randint(2, 8)))
    header = rng.choice(["<header>{}</header>", '<div class="header site">{}</div>', '<header><p>{}</p></header>']).format(words(rng, rng.randint(1, 8)))
    footer = rng.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', "<footer><p>{}</p></footer>"]).format(f"&copy; {words(rng, 1)}.example &middot; {say(rng.randint(1, 3))}")
    related = rng.choice(['<div class="related"><h3>{}</h3><ul>{}</ul></div>', '<div class="share social"><p>{}</p><ul>{}</ul></div>']).format(words(rng, 2), links(rng, 3))
    some = lambda *p: [x for x in p if rng.random() < 0.6]
    return {"before": [] if rng.random() < 0.2 else [*some(header, nav), *some(notice, ad, form)], "inside": [x for x in (ad, form, related, comments, notice, side) if rng.random() < 0.15], "after": [*some(related, comments, side, form, ad), *some(footer)]}


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Pages in which every block of the article stands inside a <main-part> tag (taken off before features are made)."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        around = furniture(rng)
        body = article(rng)
        for piece in around["inside"]:
            cut = rng.choice([len(body), body.find("</main-part>") + len("</main-part>")])
            body = body[:cut] + piece + body[cut:]
        pages.append("<html><body>" + "".join(around["before"]) + rng.choice(ARTICLE).format(body) + "".join(around["after"]) + "</body></html>")
    return pages
