"""Generated pages with a known main text: what the extraction's trees learn from."""

from __future__ import annotations

import random

#: Attribute that marks the outermost element of main text (1) or of anything else (0); no feature looks at it.
MARK = "data-main"

# Names that sites give to such elements.
AD_NAMES = ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot")
MENU_NAMES = ("nav", "menu", "navbar", "breadcrumbs", "toc", "pagination", "tabs")
SIDE_NAMES = ("sidebar", "widget", "related", "recommended", "rail", "trending", "side")
NOTICE_NAMES = ("cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal")
FORM_NAMES = ("newsletter", "subscribe", "signup", "search", "login")
SHARE_NAMES = ("share", "social", "follow")
COMMENT_NAMES = ("comments", "comment-list", "replies", "discussion", "respond", "comment")
HEAD_NAMES = ("header", "masthead", "site-header", "topbar", "branding")
FOOT_NAMES = ("footer", "site-footer", "copyright", "legal", "colophon")
MAIN_NAMES = ("content", "post", "entry-content", "article", "article-body", "story", "main", "post-body", "text")


def page(r: random.Random) -> str:
    """One page's HTML."""
    letters = "abcdefghijklmnoprstuvwéüñ"

    def words(n: int) -> str:
        out = []
        for k in range(n):
            w = "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
            out.append((w.capitalize() if k == 0 or out[-1][-1] == "." else w) + (r.choice(".,") if r.random() < 0.14 else ""))
        return " ".join(out).rstrip(".,") + r.choice((".", ".", ".", ""))

    def named(names: tuple[str, ...], main: int | None, bare: float = 0.0) -> str:
        mark = "" if main is None else f' {MARK}="{main}"'
        if r.random() < bare:
            return mark
        name = r.choice(names)
        return f' {r.choice(("class", "class", "id"))}="{name}{r.choice(("", "", " x1", " box"))}"' + mark

    def links(n: int) -> str:
        items = [f'<a href="/{k}">{words(r.randint(1, 3))}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)

    def prose(n: int) -> str:
        text = words(n)
        if r.random() < 0.25 and n > 6:
            cut = text.split(" ")
            i = r.randrange(len(cut) - 2)
            cut[i : i + 2] = [r.choice(("<a href='#'>{}</a>", "<b>{}</b>", "<em>{}</em>", "{}<br>")).format(" ".join(cut[i : i + 2]))]
            text = " ".join(cut)
        return text

    def paragraph(main: int | None = None) -> str:
        n = r.choice((1, 2, 4, 8, 15, 30, 60, 90, 140))
        tag = r.random()
        inside = prose(n)
        if tag < 0.8:
            return f"<p>{'<b>' * (r.random() < 0.05)}{inside}{'</p>' * (r.random() < 0.95)}"
        if tag < 0.87:
            return f"<h{r.randint(2, 4)}>{words(r.randint(1, 8))}</h2>"
        if tag < 0.92:
            return "<ul>" + "".join(f"<li>{prose(r.randint(2, 20))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if tag < 0.95:
            return f"<blockquote><p>{inside}</p></blockquote>"
        if tag < 0.97:
            return f"<div>{inside}</div>"
        if tag < 0.98:
            return f"<figure><figcaption>{words(6)}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(3)}</td></tr>" for _ in range(3)) + "</table>"

    def advert() -> str:
        return f"<div{named(AD_NAMES, 0)}>{r.choice((words(r.randint(2, 25)), '<p>' + words(r.randint(2, 25)) + '</p>', links(2)))}</div>"

    def aside() -> str:
        tag = r.choice(("aside", "aside", "div", "section"))
        body = f"<h3>{words(2)}</h3>" * (r.random() < 0.5) + r.choice((links(r.randint(2, 8)), f"<p>{words(r.randint(5, 40))}</p>"))
        return f"<{tag}{named(SIDE_NAMES, 0, 0.5 if tag == 'aside' else 0)}>{body}</{tag}>"

    def notice() -> str:
        return f"<div{named(NOTICE_NAMES, 0)}><p>{words(r.randint(5, 40))}</p>{'<button>' + words(1) + '</button>' if r.random() < 0.5 else ''}</div>"

    def form() -> str:
        inside = f"<label>{words(2)}</label><input type=text>" + r.choice(("", f"<p>{words(r.randint(3, 20))}</p>")) + f"<button>{words(1)}</button>"
        return f"<form{named(FORM_NAMES, 0, 0.5)}>{inside}</form>" if r.random() < 0.7 else f"<div{named(FORM_NAMES, 0)}><form>{inside}</form></div>"

    def comments() -> str:
        each = "".join(f"<{t}{named(('comment', 'reply'), None, 0.3)}><p>{words(r.randint(3, 70))}</p></{t}>" for t in r.choices(("div", "li", "article"), k=r.randint(1, 6)))
        tag = r.choice(("section", "div", "ol"))
        return f"<{tag}{named(COMMENT_NAMES, 0)}><h3>{words(2)}</h3>{each}</{tag}>"

    def menu() -> str:
        tag = r.choice(("nav", "nav", "div"))
        return f"<{tag}{named(MENU_NAMES, 0, 0.6 if tag == 'nav' else 0)}>{links(r.randint(2, 9))}</{tag}>"

    def header() -> str:
        tag = r.choice(("header", "header", "div"))
        return f"<{tag}{named(HEAD_NAMES, 0, 0.6 if tag == 'header' else 0)}>{r.choice(('<h1>{}</h1>', '<a href=/>{}</a>', '<p>{}</p>')).format(words(r.randint(1, 6)))}{menu() if r.random() < 0.5 else ''}</{tag}>"

    def footer() -> str:
        tag = r.choice(("footer", "footer", "footer", "div"))
        inside = r.choice((f"&copy; {words(2)} &middot; {words(r.randint(1, 20))}", f"<p>{words(r.randint(2, 20))}</p>", links(4)))
        return f"<{tag}{named(FOOT_NAMES, 0, 0.7 if tag == 'footer' else 0)}>{inside}</{tag}>"

    def share() -> str:
        return f"<div{named(SHARE_NAMES, 0)}>{links(r.randint(2, 4))}</div>"

    inner = [f"<h1>{words(r.randint(2, 12))}</h1>"] * (r.random() < 0.8)
    if r.random() < 0.15:
        inner = [f"<header>{''.join(inner)}<p>{words(4)}</p></header>"]
    inner += [paragraph() for _ in range(r.choice((1, 1, 2, 3, 6, 12, 25)))]
    for make, chance in ((advert, 0.25), (share, 0.12), (aside, 0.08), (form, 0.06)):
        if r.random() < chance:
            inner.insert(r.randint(1 if inner else 0, len(inner)), make())
    if r.random() < 0.12:
        inner.append(comments())
    tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
    main = f"<{tag}{named(MAIN_NAMES, 1, 0.7 if tag in ('article', 'main') else 0.15)}>{''.join(inner)}</{tag}>"
    before = [make() for make, chance in ((header, 0.5), (menu, 0.7), (notice, 0.3), (advert, 0.5), (form, 0.1)) if r.random() < chance]
    after = [make() for make, chance in ((share, 0.1), (aside, 0.4), (comments, 0.3), (form, 0.2), (advert, 0.2), (notice, 0.1), (footer, 0.8)) if r.random() < chance]
    r.shuffle(before)
    middle = "".join(before) + main + "".join(after[:-1]) + "".join(after[-1:])
    for _ in range(r.choice((0, 0, 0, 1, 2))):
        middle = f"<div{named(('page', 'wrapper', 'container', 'site', 'row'), None, 0.3)}>{middle}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style><script>var x='<p>';</script></head><body><!-- {words(2)} -->{middle}</body></html>"
