"""Made-up pages whose blocks are labelled by construction: what the block labeller is trained and tested on."""

from __future__ import annotations

import random

_SYLLABLES = "an ber ch de el fa gor hi ion ka lu men nor os pre qui ra st th un ver wo xi yl zu er ti ing re la che que ment".split()
_CUES = {
    "nav": "home about contact products news login menu archive search help".split(),
    "ad": "sponsored advertisement buy now offer sale deal discount promo free shop".split(),
    "notice": "cookies accept consent privacy settings policy we use agree browser updated subscribe".split(),
    "form": "name email password submit send sign up your address required search newsletter".split(),
    "comment": "reply says posted ago thanks great i agree comment user guest likes".split(),
    "side": "related popular recent tags more stories trending categories follow share".split(),
    "foot": "copyright © rights reserved terms privacy imprint contact 2024 inc".split(),
}
_CONTAINERS = {
    "nav": ['nav', 'div class="menu"', 'ul class="nav navbar"', 'div id="navigation"', 'div role="navigation"', 'div class="breadcrumbs"', 'div class="pagination"', 'div class="top-menu"'],
    "head": ['header', 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'div role="banner"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div id="banner-ad"', 'div class="sponsored"', 'aside class="promo"', 'section class="advertisement"', 'div class="adsbox"'],
    "side": ['aside', 'div class="sidebar"', 'div id="sidebar"', 'section class="related"', 'div class="widget"', 'div class="share social"', 'aside class="sidebar"', 'div role="complementary"'],
    "notice": ['div class="cookie-notice"', 'div id="cookie-consent"', 'div class="notice"', 'div class="popup"', 'div class="alert"', 'section class="newsletter"', 'div class="banner"', 'div role="alert"'],
    "form": ['form', 'form action="/x" class="search"', 'form method="post" id="signup"', 'fieldset'],
    "comment": ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'section id="comments"', 'div class="comments"', 'div class="discussion replies"'],
    "foot": ['footer', 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div role="contentinfo"'],
}
_MAIN = ['article', 'article', 'article', 'main', 'div class="content"', 'div id="content"', 'div class="post"', 'article class="entry"', 'div class="article-body"', 'section class="story"', 'div role="main"', 'main id="main"', 'main id="primary" class="site-main"', 'article class="post type-post hentry"', 'main class="main-content"', 'div id="main" class="site-content"', 'div class="page-body"', 'div class="blog-post"']

#: What stands around a whole page, or within the main part, without telling anything.
_OUTER = ['div id="page"', 'div class="container"', 'div id="wrapper"', 'div class="site"', 'div id="page" class="hfeed site"', 'div class="row"', 'div class="layout"', 'div id="root"']
_INNER = ['div class="entry-content"', 'div class="post-body"', 'div class="article-content"', 'div itemprop="articleBody"', 'div class="text"', 'section class="content"', 'div class="post-content"', 'div class="story-body"', 'div class="field body"', 'div']
_MARKS = ["lead", "intro", "first", "text", "block", "item", "title", "col", "inner", "main", "small", "large", "left", "right", "wide", "entry-title", "widget-title", "menu-item", "wp-block", "paragraph"]


class Pages:
    """Repeatable: one seed, one sequence of (html, [(text, is main text), ...])."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def _word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def _text(self, cue: str | None, low: int, high: int) -> str:
        r = self.r
        words = [r.choice(_CUES[cue]) if cue and r.random() < 0.3 else self._word() for _ in range(r.randint(low, high))]
        if r.random() < 0.1:
            words = [w.upper() + "!!" for w in words]
        elif r.random() < 0.1:
            words = [w + r.choice(["***", "&&&", "%%%", "$$$"]) for w in words]
        text = " ".join(words)
        return text[:1].upper() + text[1:] + r.choice([".", ".", "", "!", "?"])

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        r, out, truth = self.r, [], []
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")

        def leaf(tag: str, text: str, main: bool, link: bool = False, open_end: bool = False) -> None:
            body = esc(text)
            body = f'<a href="/{len(out)}">{body}</a>' if link else body
            body = f"<b>{body}" + "</b>" * (r.random() < 0.5) if r.random() < 0.15 else body
            body += "<br>" * (r.random() < 0.1)
            if r.random() < 0.15 and " " not in tag:
                tag += f' class="{r.choice(_MARKS) if r.random() < 0.6 else self._word()}"'
            out.append(f"<{tag}>{body}" + ("" if open_end else f"</{tag.split()[0]}>"))
            truth.append((text, main))

        def chrome(kind: str) -> None:
            box = r.choice(_CONTAINERS[kind])
            cue = {"head": "nav"}.get(kind, kind)
            wrap = r.random() < 0.2
            grid = kind in ("nav", "side", "ad") and r.random() < 0.12
            box = r.choice(['td class="sidebar"', 'td class="nav"', 'td id="menu"', 'td class="left"', "td"]) if grid else box
            out.append('<table class="layout"><tr>' * grid + "<div>" * (wrap and not grid) + f"<{box}>")
            shape = {"nav": "list", "foot": "plain", "ad": "plain", "notice": "plain"}.get(kind) or r.choice(["list", "plain", "paras"])
            if kind == "form":
                for _ in range(r.randint(1, 4)):
                    leaf(r.choice(["p", "div", "button", "legend", "p"]), self._text(cue, 1, 6), False)
                    out.append('<input type="text" name="q"/>')
            elif kind == "comment":
                for _ in range(r.randint(1, 6)):
                    leaf(r.choice(["p", "li", "div class=\"comment\"", "p"]), self._text(cue, 3, 40), False)
            elif shape == "list" or "ul" in box:
                out.append("<ul>")
                for _ in range(r.randint(2, 9)):
                    leaf("li", self._text(cue if r.random() < 0.5 else None, 1, 3), False, link=True, open_end=r.random() < 0.1)
                out.append("</ul>")
            elif shape == "plain" and r.random() < 0.7:
                text = self._text(cue if r.random() < 0.5 else None, 2, 40)
                out.append(esc(text))
                truth.append((text, False))
            else:
                for _ in range(r.randint(1, 4)):
                    leaf(r.choice(["p", "h3", "h4", "div", "span" if False else "p"]), self._text(cue if r.random() < 0.5 else None, 2, 30), False, link=r.random() < 0.3)
            out.append(f"</{box.split()[0]}>" + "</div>" * (wrap and not grid) + "</tr></table>" * grid)

        title = self._text(None, 2, 10)
        out.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{esc(title)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>")
        truth.append((title, False))
        outer = [r.choice(_OUTER) for _ in range(r.choice([0, 0, 0, 1, 1, 2]))]
        out += [f"<{x}>" for x in outer]
        for kind in r.sample(["nav", "head", "ad", "notice", "side", "form"], r.randint(1, 5)):
            if r.random() < 0.8:
                chrome(kind)
        wrap = r.random() < 0.3
        main = r.choice(_MAIN)
        out.append('<div class="wrapper">' * wrap + f"<{main}>")
        within = r.choice(_MAIN) if r.random() < 0.3 else ""
        out.append(f"<{within}>" if within else "")
        top = r.random()
        out.append('<header class="entry-header">' if top < 0.05 else "<header>" * (top < 0.1))
        if r.random() < 0.9:
            leaf("h1", title if r.random() < 0.6 else self._text(None, 2, 10), True)
        out.append("</header>" * (top < 0.1))
        inner = [r.choice(_INNER) for _ in range(r.choice([0, 0, 0, 1, 1, 2]))]
        out += [f"<{x}>" for x in inner]
        few = r.random() < 0.3
        for _ in range(r.randint(1, 2) if few else r.randint(2, 16)):
            kind, x = r.random(), r.random()
            if kind < 0.7:
                leaf("p", self._text(None, 1, 90), True, open_end=x < 0.15)
            elif kind < 0.78:
                leaf(r.choice(["h2", "h3", "h4"]), self._text(None, 1, 7), True)
            elif kind < 0.86:
                out.append("<ul>" if x < 0.6 else "<ol>")
                for _ in range(r.randint(1, 5)):
                    leaf("li", self._text(None, 1, 25), True, link=r.random() < 0.15)
                out.append("</ul>" if x < 0.6 else "</ol>")
            elif kind < 0.9:
                tag = r.choice(["blockquote", "pre", "div", "figcaption", "div class=\"text\"", "section", "quoted"])
                out.append("<blockquote>" * (tag == "quoted"))
                leaf("p" if tag == "quoted" else tag, self._text(None, 2, 50), True)
                out.append("</blockquote>" * (tag == "quoted"))
            elif kind < 0.93:
                out.append("<table><tr>")
                for _ in range(r.randint(2, 6)):
                    leaf("td", self._text(None, 1, 4), True)
                out.append("</tr></table>")
            elif kind < 0.96:
                chrome(r.choice(["ad", "side", "notice", "form"]))
            else:
                out.append("<!-- note --><script>x('<p>no</p>')</script>")
        out += [f"</{x.split()[0]}>" for x in [*reversed(inner), within] if x]
        if r.random() < 0.1:
            chrome("comment")
        out.append(f"</{main.split()[0]}>" + "</div>" * wrap)
        for kind in ("comment", "side", "ad", "form", "notice", "foot"):
            if r.random() < (0.8 if kind == "foot" else 0.3):
                chrome(kind)
        out += [f"</{x.split()[0]}>" for x in reversed(outer)]
        return "".join(out) + "</body></html>", truth
