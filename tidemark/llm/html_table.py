"""The small labelled table that the block classifier is trained on, and the pages made of it.

A row of ROWS is a kind of block: its role, label (1 is main text), how many words, how many of them
in links, and the element it comes in. Pages combine rows by rule, in five styles: elements that say
what they are, plain divisions with class names, divisions without names, names that mislead
(on the page, on boxes around the article, or mixed), and bare text.
"""

from __future__ import annotations

import random

# Role, label, least and most words, share of words in links, markup (% is the text).
ROWS = [
    ("title", 1, 1, 12, 0.0, "<h1>%</h1>"),
    ("text", 1, 26, 120, 0.0, "<p>%</p>"),
    ("text", 1, 26, 90, 0.08, "<p>%</p>"),
    ("text", 1, 9, 25, 0.0, "<p>%</p>"),
    ("text", 1, 9, 25, 0.3, "<p>%</p>"),
    ("text", 1, 1, 8, 0.0, "<p>%</p>"),
    ("text", 1, 4, 60, 0.0, "<p><b>%<br><p>"),
    ("text", 1, 12, 80, 0.0, "<div>%</div>"),
    ("text", 1, 3, 12, 1.0, "<p>%</p>"),
    ("text", 1, 2, 30, 0.0, "<blockquote>%</blockquote>"),
    ("text", 1, 2, 20, 0.0, "<ul><li>%</li><li>%</li></ul>"),
    ("alone", 1, 1, 30, 0.0, "%<hr>"),
    ("part", 1, 1, 8, 0.0, "<h2>%</h2>"),
    ("menu", 0, 1, 2, 1.0, "<ul><li>%</li><li>%</li><li>%</li><li>%</li></ul>"),
    ("menu", 0, 1, 3, 1.0, "<ul><li>%</li><li>%</li></ul>"),
    ("menu", 0, 4, 9, 1.0, "<div>%</div>"),
    ("menu", 0, 4, 9, 0.8, "<p>%</p>"),
    ("header", 0, 1, 8, 0.0, "<p>%</p>"),
    ("header", 0, 1, 4, 1.0, "<div>%</div>"),
    ("footer", 0, 2, 9, 0.0, "%"),
    ("footer", 0, 10, 30, 0.0, "<p>%</p>"),
    ("footer", 0, 3, 12, 0.7, "<p>%</p>"),
    ("side", 0, 1, 3, 0.0, "<h3>%</h3><ul><li>%</li></ul>"),
    ("side", 0, 4, 30, 0.0, "<p>%</p>"),
    ("side", 0, 3, 10, 1.0, "<ul><li>%</li><li>%</li><li>%</li></ul>"),
    ("notice", 0, 5, 40, 0.1, "%"),
    ("notice", 0, 3, 12, 0.0, "<p>%</p>"),
    ("advert", 0, 3, 30, 0.0, "%"),
    ("advert", 0, 4, 15, 1.0, "<p>%</p>"),
    ("form", 0, 2, 9, 0.0, "% <input name=q> <button>Go</button>"),
    ("form", 0, 6, 20, 0.0, "<p>%</p><select><option>all</option></select>"),
    ("comment", 0, 1, 80, 0.0, "<p>%</p><p>%</p>"),
    ("comment", 0, 2, 30, 0.0, "<div>%</div><div>%</div><div>%</div>"),
]
# Elements and names of boxes by role, and names that say nothing of the text.
ELEMENTS = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
NAMED = {
    "menu": ["menu", "main-nav", "breadcrumbs", "navbar", "top-navigation"],
    "header": ["site-header", "masthead"],
    "footer": ["footer", "site-footer", "copyright"],
    "side": ["sidebar", "related-posts", "widget", "share-box", "social"],
    "notice": ["cookie-notice", "consent", "banner", "disclaimer"],
    "advert": ["ad", "ads", "banner-ad", "sponsored", "promo-box"],
    "form": ["newsletter", "search-form", "signup", "login"],
    "comment": ["comments", "comment-list", "post-comments", "replies"],
}
MISLEADING = ["has-sidebar", "header-fixed", "login", "promo-free-layout social", "content share-box", "no-ads", "with-footer", "post related", "story newsletter", "menu-open content", "entry banner"]
AROUND = ["social", "sidebar", "widget", "promo", "banner", "header", "share-box", "login", "overlay"]
PASSAGE = "the river rose in the night and by morning it had taken the lower bridge two sheds and most of the road to the mill nobody was hurt"


def _block(rng: random.Random, row: tuple) -> str:
    _, _, least, most, share, markup = row
    out = markup
    while "%" in out:
        n = rng.randint(least, most)
        words = [rng.choice(PASSAGE.split()) for _ in range(n)]
        linked = n if share == 1 else round(share * n)
        if linked:
            words[:linked] = [f"<a href=/x>{' '.join(words[:linked])}</a>"]
        out = out.replace("%", " ".join(words), 1)
    return out


def _box(rng: random.Random, role: str, style: str, inner: str) -> str:
    if style == "bare":
        return f"<div>{inner}</div>"
    if style == "elements" and role in ELEMENTS:
        return f"<{ELEMENTS[role]}>{inner}</{ELEMENTS[role]}>"
    name = rng.choice(NAMED[role])
    tag = "section" if rng.random() < 0.2 else "div"
    return f"<{tag} {rng.choice(('class', 'id'))}='{name}'>{inner}</{tag}>"


def _article(rng: random.Random, style: str, of: dict[str, list[tuple]]) -> list[tuple[int, str]]:
    if style in ("elements", "names") and rng.random() < 0.12:  # hardly any text at all
        return [(1, _block(rng, ("title", 1, 1, 3, 0.0, "<h1>%</h1>"))), (1, _block(rng, of["text"][5]))]
    out = [(1, _block(rng, rng.choice(of["title"])))] if rng.random() < 0.8 else []
    for k in range(rng.choice((1, 2, 3, 4, 6, 9))):
        if k and rng.random() < 0.2:
            out.append((1, _block(rng, rng.choice(of["part"]))))
        # the first of a run is a paragraph, then anything; a link alone only within text
        row = rng.choice(of["text"][:4]) if k == 0 else rng.choice(of["text"])
        out.append((1, _block(rng, row)))
        if style != "bare" and rng.random() < 0.15:
            role = rng.choice(("advert", "side", "form", "notice"))
            out.append((0, _box(rng, role, style, _block(rng, rng.choice(of[role])))))
    if out[-1][0] and out[-1][1].startswith("<p><a"):
        out.append((1, _block(rng, of["text"][1])))
    return out


def _opened(rng: random.Random, style: str) -> tuple[str, str, str]:
    """What opens the article, what closes it, and the page's own names."""
    tag = rng.choice(("article", "main", "div")) if style in ("elements", "misleading") else "div"
    name = rng.choice(("", " class='content'", " id='main-content'", " class='post entry'")) if style != "bare" else ""
    before, after, body = "", "", ""
    if style == "misleading":
        wrong = rng.choice(MISLEADING)
        which = rng.randrange(4)
        if which == 0:
            name = f" class='{wrong}'" if tag != "div" else f" class='content {wrong}'"
        elif which == 1:
            body = f" class='{wrong}'"
        elif which == 2:
            before, after = f"<div class='{wrong}'>", "</div>"
        else:
            before, after = f"<div class='{rng.choice(AROUND)}'>", "</div>"
            if tag == "div":
                name = ""
    return f"{before}<{tag}{name}>", f"</{tag}>{after}", body


def pages(count: int = 1500, seed: int = 11) -> list[list[tuple[int, str]]]:
    """Pages as lists of (label, fragment)."""
    rng, of = random.Random(seed), {}
    for row in ROWS:
        of.setdefault(row[0], []).append(row)
    out = []
    for k in range(count):
        style = ("elements", "names", "bare", "misleading", "text")[k % 5]
        if style == "text":
            menu = [(0, _box(rng, "menu", "elements", _block(rng, rng.choice(of["menu"]))))] if rng.random() < 0.5 else []
            foot = [(0, _box(rng, "footer", "elements", _block(rng, rng.choice(of["footer"]))))] if rng.random() < 0.5 else []
            plain = [*of["alone"], *of["alone"], of["text"][5], of["text"][5], of["text"][1], of["text"][3], of["text"][6]]
            out.append([*menu, *((1, _block(rng, rng.choice(plain))) for _ in range(rng.choice((1, 1, 2, 4)))), *foot])
            continue
        opens, closes, body = _opened(rng, style)
        inner = style if style != "misleading" else rng.choice(("elements", "names"))
        page = [(0, f"<html><head><title>{_block(rng, of['title'][0])[4:-5]}</title></head><body{body}>")]
        roles = ["menu", "header", "advert", "notice", "menu"] if style != "bare" else ["menu", "menu", "header"]
        page += [(0, _box(rng, r, inner, _block(rng, rng.choice(of[r])))) for r in roles if rng.random() < (0.6 if r != "menu" else 0.9)]
        if style == "bare" and len(page) < 3:  # nothing but a menu tells where such a page's text begins
            page.append((0, _box(rng, "menu", inner, _block(rng, of["menu"][0]))))
        if style == "misleading" and rng.random() < 0.5:
            page, start = page[:1], page[1:]
            page += [(0, opens), *start, *_article(rng, inner, of), (0, closes)] if "<div" in opens[:4] and opens.count("<") > 1 else [*start, (1, opens), *_article(rng, inner, of), (1, closes)]
        else:
            page += [(1, opens), *_article(rng, inner, of), (1, closes)]
        roles = ["comment", "side", "form", "menu", "advert", "footer", "notice"] if style != "bare" else ["menu", "side_links", "menu", "footer"]
        for r in roles:
            if rng.random() < 0.6:
                row = rng.choice(of[r]) if r != "side_links" else of["side"][2]
                if style == "bare" and r == "footer":
                    row = of["footer"][rng.choice((0, 2))]
                page += [(0, _box(rng, r if r != "side_links" else "side", inner, _block(rng, row)))]
                if r == "comment":
                    page += [(0, _box(rng, r, inner, "".join(_block(rng, rng.choice(of[r])) for _ in range(rng.choice((1, 2, 8))))))]
        out.append(page)
    return out
