"""Labelled training pages for the content model, made by rule from page layouts.

Many pages have no names, or names that mean nothing. Each page is an article among menus, headers, footers, sidebars, notices, adverts, forms and comments, in the markup that
sites commonly use for them. The attribute ``data-y`` labels an element and what is in it: 1 is content, 0 is not.
"""

from __future__ import annotations

import random

#: Names that sites give to the parts of a page.
MENU = "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu site-nav mega-menu pagination pager toc skip-link tabs".split()
HEADER = "header site-header masthead topbar page-header branding logo banner-top".split()
FOOTER = "footer site-footer page-footer copyright legal bottom colophon footer-links contentinfo credits".split()
SIDEBAR = "sidebar side aside rail widget right-col left-col related related-posts recommended trending popular secondary tags tag-list author-box see-also more-news complementary newsbox teasers".split()
NOTICE = "notice cookie cookies cookie-banner cookie-notice consent gdpr alert banner paywall popup modal overlay toast newsletter subscribe-box disclaimer announcement warning message dialog alertdialog status privacy gdpr-banner breaking".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promoted adsense banner-ad ad-slot dfp promotion teaser cta adsbygoogle ad-container native-ad commercial".split()
FORM = "form search search-form login signup subscribe contact-form newsletter-form comment-form feedback".split()
SOCIAL = "share social sharing follow social-links share-buttons".split()
COMMENTS = "comments comment comment-list reader-comments responses discussion replies disqus user-comments comments-area comment-body feedback-list reviews respond thread".split()
CONTENT = "content article post entry story main article-body post-content entry-content story-body main-content text body-text page-content article-content prose single hentry".split()
#: What sites append to such names.
SUFFIXES = "content body text inner wrapper wrap container list item items box area main section block title links".split()
#: Names of elements around everything.
WRAPPERS = "wrapper container page wrap layout outer inner row site app root page-wrapper page-container site-content".split()
#: What they put before the names of the article.
PREFIXES = "main page post article entry site single primary story the".split()
_SYLLABLES = "ba ce di fo gu la me ni so tu ra pe lo mi ka ve da ro".split()


def _words(r: random.Random, n: int) -> str:
    out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(out).capitalize()


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(2, 18)) + r.choice(("." if r.random() < 0.9 else "!", ".", "?")) for _ in range(n))


def _attrs(r: random.Random, names: list[str], sure: bool) -> str:
    if not sure and r.random() < 0.35:
        return ""
    kind = r.choice(("class", "class", "id", "role"))
    if not sure and r.random() < 0.3:  # a name that tells nothing
        return f' {kind}="{_unknown(r)}"'
    name = r.choice(names)
    if names[0] not in (CONTENT[0], WRAPPERS[0]) and r.random() < 0.25:
        name += r.choice("-_ ") + r.choice(SUFFIXES)
    elif names[0] == CONTENT[0] and r.random() < 0.4:
        name = r.choice(PREFIXES) + r.choice("-_ ") + name
    return f' {kind}="{name}"'


def _unknown(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(3)) + r.choice(("", "-x", f"-{r.randint(1, 99)}", "__inner"))


def _hidden(r: random.Random, inner: str) -> str:
    return f"<div {r.choice(('hidden', 'aria-hidden="true"', 'style="display:none"', 'hidden=""'))} data-y=\"0\">{inner}</div>"


def _nameless(r: random.Random, inner: str) -> str:
    """An article in elements without names, or with names that tell nothing."""
    for _ in range(r.randint(0, 3)):
        inner = f"<{(t := r.choice(('div', 'div', 'section')))}{'' if r.random() < 0.6 else f' class="{_unknown(r)}"'}>{inner}</{t}>"
    return inner


def _links(r: random.Random, n: int) -> str:
    items = [f'<a href="/{k}">{_words(r, r.randint(1, 3))}</a>' for k in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " ".join(items)


def _part(r: random.Random, tag: str, names: list[str], inner: str) -> str:
    """A part that isn't content: by its tag, or as a div with a name."""
    own = r.random() < 0.5 and tag != "div"
    t = tag if own else r.choice(("div", "div", "section"))
    if r.random() < 0.2:
        inner = f'<div{r.choice(("", f' class="{r.choice(SUFFIXES)}"'))}>{inner}</div>'
    return f'<{t}{_attrs(r, names, not own)} data-y="0">{inner}</{t}>'


def _prose(r: random.Random) -> str:
    p = f"<p>{_sentences(r, r.randint(1, 6))}</p>"
    return p if r.random() < 0.8 else f"<p>{_sentences(r, 1)} <a href='/x'>{_words(r, 2)}</a> {_sentences(r, 1)}</p>"


def _text(r: random.Random) -> str:
    """A paragraph of an article, of any length."""
    return _prose(r) if r.random() < 0.5 else f"<p>{_words(r, r.randint(1, 9))}{r.choice(('.', '', ':'))}</p>"


def _heading(r: random.Random) -> str:
    t = r.choice(("h2", "h2", "h3", "h3", "h4"))
    return f"<{t}>{_words(r, r.randint(1, 5))}</{t}>"


def _comment(r: random.Random) -> str:
    who = f"<b>{_words(r, 2)}</b>"
    return r.choice((f"<div class='comment'>{who}<p>{_sentences(r, r.randint(1, 3))}</p></div>", f"<li>{who} {_sentences(r, 2)}</li>", f"<article class='comment'><p>{_sentences(r, 2)}</p></article>", _prose(r)))


def _outer(r: random.Random) -> list[tuple[float, str]]:
    """Parts around the article, each with its place: before it (under 0.5) or after it."""
    fields = "".join(f'<label>{_words(r, 1)}</label><input name="f{k}">' for k in range(r.randint(1, 3))) + f"<button>{_words(r, 1)}</button>"
    parts = [
        (0.1, _part(r, "nav", MENU, _links(r, r.randint(2, 8)))),
        (0.05, _part(r, "header", HEADER, f"<a href='/'>{_words(r, 2)}</a><p>{_words(r, 4)}</p>")),
        (0.95, _part(r, "footer", FOOTER, r.choice((f"&copy; {_words(r, 3)}.", f"<p>{_sentences(r, 2)}</p>", _links(r, 4))))),
        (r.random(), _part(r, "aside", SIDEBAR, r.choice((_heading(r) + f"{_links(r, 5)}", _text(r), _heading(r) + f"{_text(r)}")))),
        (r.random(), _part(r, "div", NOTICE, r.choice((_sentences(r, 2), _text(r), f"<p>{_sentences(r, 1)}</p><button>{_words(r, 1)}</button>")))),
        (r.random(), _part(r, "div", ADVERT, r.choice((_sentences(r, 1), _text(r), f"<a href='/buy'>{_words(r, 5)}</a>")))),
        (r.random(), f'<form{_attrs(r, FORM, False)} data-y="0">{fields}{r.choice(("", _text(r)))}</form>'),
        (r.random(), _part(r, "div", SOCIAL, _links(r, 3))),
        (r.random(), _hidden(r, r.choice((_text(r), _sentences(r, 2))))),
        (0.9, _part(r, "section", COMMENTS, _heading(r) + f"" + "".join(_comment(r) for _ in range(r.randint(1, 4))))),
    ]
    return [p for p in parts if r.random() < 0.6]


def _bare(r: random.Random) -> str:
    """A page of little else than its text."""
    parts = [_text(r) if r.random() < 0.7 else f"<div>{_sentences(r, r.randint(1, 5))}</div>" for _ in range(r.choice((1, 1, 2, 3, 6, 10)))]
    if r.random() < 0.5:
        parts.insert(0, f"<{(t := r.choice(('h1', 'h1', 'h2')))}>{_words(r, r.randint(1, 7))}</{t}>")
    cut = r.randint(0, len(parts))
    inner = _nameless(r, "".join(parts)) if r.random() < 0.7 else _nameless(r, "".join(parts[:cut])) + _nameless(r, "".join(parts[cut:]))
    around = [p for _, p in sorted(_outer(r)) if r.random() < 0.25]
    k = r.randint(0, len(around))
    return "".join(around[:k]) + _nameless(r, inner) + "".join(around[k:])


def page(seed: int) -> str:
    r = random.Random(seed)
    if r.random() < 0.4:
        return f'<html><head><title>{_words(r, 4)}</title></head><body data-y="1">{_bare(r)}</body></html>'
    body = [f"<h1>{_words(r, r.randint(2, 9))}</h1>"] * (r.random() < 0.9)
    for _ in range(r.randint(1, 9)):
        x = r.random()
        body.append(
            _text(r) if x < 0.66
            else _heading(r) if x < 0.75
            else "<ul>" + "".join(f"<li>{_sentences(r, 1) if r.random() < 0.6 else _words(r, 3)}</li>" for _ in range(r.randint(1, 6))) + "</ul>" if x < 0.82
            else f"<blockquote>{_text(r) if r.random() < 0.6 else _sentences(r, r.randint(1, 3))}</blockquote>" if x < 0.86
            else f"<table><tr><td>{_words(r, 2)}</td><td>{_words(r, 1)}</td></tr></table>" if x < 0.89
            else f"<div>{_sentences(r, 3)}</div>" if x < 0.96
            else f"<pre>{_words(r, 8)}</pre>"
        )
    if r.random() < 0.25:
        body[0] = f"<header>{body[0]}</header>"
    within = r.choice((0.0, 0.1, 0.5, 0.9))
    for place, part in _outer(r):
        if r.random() < within:  # some stand inside the article
            body.insert(1 + int(place * (len(body) - 1)), part)
    tag = r.choice(("article", "article", "main", "div", "section"))
    article = f'<{tag}{_attrs(r, CONTENT, tag in ("div", "section") and r.random() < 0.6)}>{"".join(body)}</{tag}>' if r.random() < 0.8 else "".join(body)
    if r.random() < 0.4:
        article = f"<main>{article}</main>" if r.random() < 0.5 else f"<div{_attrs(r, r.choice((CONTENT, WRAPPERS)), False)}>{article}</div>"
    outer = _outer(r)
    before, after = ([p for _, p in sorted(outer) if (_ < 0.5) == side] for side in (True, False))
    inner = "".join([*before, article, *after])
    if r.random() < 0.4:
        inner = f"<div{_attrs(r, WRAPPERS, False)}>{inner}</div>"
    return f'<html><head><title>{_words(r, 4)}</title></head><body data-y="1">{inner}</body></html>'
