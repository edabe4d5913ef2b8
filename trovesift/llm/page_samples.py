"""Labelled web pages: invented articles in many layouts, each with its main text.

They stand in for hand-labelled pages: the model of `html_extract` learns on them which
places and shapes of blocks are main text, and never sees the pages that it is used on.
"""

from __future__ import annotations

import random
import re

# What sites call the parts of their pages.
CONTAINERS = ("article", "article", "article .post", "main", "main", "main article", "div article", "div #content", "div .post-content", "div .entry-content", "div .story-body", "section .article-body", "div itemprop=articleBody", "div role=main", "div .text", "div #main-content", "td", "div", "section", "div .blog-post", "div .page-body", "")
MENUS = ("nav", "nav .main-nav", "ul .menu", "div #navbar", "div role=navigation", "div .navigation", "div #menu", "ul .nav", "header nav", "div .breadcrumbs", "div .topbar", "div .toc", "div .pagination", "div .tabs")
HEADERS = ("header", "div #header", "div .masthead", "div .site-header", "div #top", "header .banner", "div role=banner")
FOOTERS = ("footer", "footer .site-footer", "div #footer", "div .footer-links", "div .copyright", "div role=contentinfo", "div #bottom", "div .legal", "div .colophon")
SIDEBARS = ("aside", "div .sidebar", "div #sidebar", "aside .widget", "div #rightcol", "div .widget-area", "div role=complementary", "div .rail", "td .side")
ADVERTS = ("div .ad", "div .ads", "div .advert", "div .advertisement", "div #banner-ad", "aside .sponsored", "div .promo", "ins .adsbygoogle", "div .sponsor", "section .promotion", "div .ad-slot", "div .commercial")
NOTICES = ("div .cookie-banner", "div #cookie-notice", "div .notice", "div role=alert", "div .alert", "div #consent", "div .gdpr", "div .popup", "div .modal", "div .warning", "div .paywall", "dialog", "div .announcement", "div .subscribe-box")
COMMENTS = ("section #comments", "div .comments", "ol .commentlist", "div #disqus-thread", "div .comment-section", "section .responses", "div .discussion", "div .replies", "div .reader-comments", "div .user-reviews")
FORMS = ("form", "form .search", "form #login", "form .newsletter", "form .comment-form", "div .signup", "form .contact")
RELATED = ("div .related", "aside .related-posts", "div .recommended", "section .more-stories", "div .share", "ul .social", "div .tags", "div .author-box", "div .read-next", "div .trending", "div .meta-links")
SAYINGS = {
    "menu": ("Home", "About", "About us", "Contact", "News", "Sport", "Blog", "Archive", "Login", "Sign in", "Register", "Products", "Help", "FAQ", "Skip to content", "Search", "Start", "Kontakt", "Accueil", "Inicio"),
    "button": ("Search", "Submit", "Send", "Subscribe", "Accept", "OK", "Post comment", "Reply", "Share", "Close", "Log in", "Follow"),
    "notice": ("This site uses cookies.", "We use cookies to improve your visit.", "Please enable JavaScript.", "Subscribe to read more.", "By using this site you accept our terms.", "Sign up for our newsletter."),
    "footer": ("All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Sitemap", "Copyright", "Powered by"),
    "heads": ("Comments", "Related", "Most read", "Recent posts", "Categories", "Leave a reply", "Share this", "Tags", "Responses", "Advertisement", "Sponsored", "Popular"),
}
SYLLABLES = ("the an er in on re ti es or te", "de la que el en os as ción ar ue", "der die sch ein ung ver en er ich ä", "le la de ou eau ai on é que tre", "ka ta no shi mi ra ku to ri ha", "на по ст ро ко ни ра ть ов ла")


class Writer:
    """Writes a page piece by piece, and the main text beside it."""

    def __init__(self, seed: int, number: int) -> None:
        self.rng = random.Random(f"{seed}:{number}")
        self.syllables = self.rng.choice(SYLLABLES).split()
        self.out: list[str] = []
        self.text: list[str] = []
        self.loose = self.rng.random() < 0.3  # closing tags are left out
        self.shout = self.rng.random() < 0.08  # tags in capitals

    def maybe(self, chance: float) -> bool:
        return self.rng.random() < chance

    def word(self) -> str:
        return "".join(self.rng.choices(self.syllables, k=self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(least, most)))

    def prose(self, least: int, most: int) -> str:
        """Sentences, sometimes cut off."""
        out = [self.word() for _ in range(self.rng.randint(least, most))]
        start = True
        for k in range(len(out)):
            out[k] = out[k].capitalize() if start else out[k]
            start = self.maybe(0.09) or k == len(out) - 1 and self.maybe(0.9)
            out[k] += self.rng.choice("....!?") if start else "," if self.maybe(0.08) else ""
            if self.maybe(0.01):
                out[k] += self.rng.choice(("%%%", "***", " &amp;", " 2024", " &quot;", "###"))
        return " ".join(out)

    def tag(self, name: str, attributes: str = "") -> None:
        name = name.upper() if self.shout else name
        self.out.append(f"<{name}{attributes}>")

    def end(self, name: str) -> None:
        if not (self.loose and name in ("p", "li", "td", "tr", "b", "dd", "dt", "html", "body")):
            self.out.append(f"</{name.upper() if self.shout else name}>")

    def open(self, place: str, plain: float = 0.0) -> list[str]:
        """Open `tag .class` or the like, nested by spaces between tags; the names to close."""
        names, attributes = [], {}
        for part in place.split():
            if part[0] in ".#" or "=" in part:
                key, value = ("class", part[1:]) if part[0] == "." else ("id", part[1:]) if part[0] == "#" else part.split("=")
                attributes[names[-1]] = f' {key}="{value}"' if self.maybe(0.85) else f" {key}={value}"
            else:
                names.append(part)
        for name in names:
            own = "" if self.maybe(plain) else attributes.get(name, "")
            if not own and self.maybe(0.15):
                own = f' class="{self.word()}{self.rng.randint(1, 99)}"'
            self.tag(name, own)
        return names[::-1]

    def close(self, names: list[str]) -> None:
        for name in names:
            self.end(name)
        self.out.append(self.rng.choice(("", "", "\n", "\n  ")))

    def say(self, text: str, main: bool) -> None:
        """Text into the page; into the main text too, as it reads there."""
        if main:
            from html import unescape

            self.text.append(" ".join(unescape(text).split()))
        if len(text) > 60 and self.maybe(0.3):  # inline markup within
            words = text.split(" ")
            k = self.rng.randrange(len(words) - 3)
            tag = self.rng.choice(("b", "i", "em", "a", "span", "strong"))
            words[k] = f"<{tag} href=x>{words[k]}" if tag == "a" else f"<{tag}>{words[k]}"
            words[k + 2] = f"{words[k + 2]}</{tag}>"
            text = " ".join(words)
        self.out.append(text.replace(" ", "\n", 1) if self.maybe(0.1) else text)

    def piece(self, tag: str, text: str, main: bool, attributes: str = "") -> None:
        self.tag(tag, attributes)
        self.say(text, main)
        self.end(tag)

    def links(self, least: int, most: int, short: bool) -> None:
        inside = self.maybe(0.75)
        self.tag("ul") if inside else None
        for _ in range(self.rng.randint(least, most)):
            text = self.rng.choice(SAYINGS["menu"]) if self.maybe(0.25) else self.words(1, 2) if short else self.prose(3, 9)
            self.out.append(f'<{"li" if inside else "div"}><a href="/{self.word()}">{text}</a></{"li" if inside else "div"}>')
        self.end("ul") if inside else None

    def aside(self, kind: str) -> None:
        """A part that is not main text."""
        places = {"menu": MENUS, "header": HEADERS, "footer": FOOTERS, "sidebar": SIDEBARS, "advert": ADVERTS, "notice": NOTICES, "comments": COMMENTS, "form": FORMS, "related": RELATED}[kind]
        names = self.open(self.rng.choice(places), 0.1 if kind in ("menu", "header", "footer", "form") else 0.0)
        if kind in ("sidebar", "related", "comments") and self.maybe(0.6):
            self.piece(self.rng.choice(("h2", "h3", "h4", "div")), self.rng.choice(SAYINGS["heads"]) if self.maybe(0.6) else self.words(1, 3).capitalize(), False)
        if kind == "menu":
            self.links(2, 9, True)
        elif kind == "header":
            self.piece(self.rng.choice(("h1", "div", "a", "p", "span")), self.words(1, 4).title(), False)
            if self.maybe(0.5):
                self.piece("p", self.prose(3, 10), False)
            if self.maybe(0.4):
                self.aside("menu")
        elif kind == "footer":
            self.say(f"&copy; {self.word()}.example.com &middot; {self.prose(3, 30)}" if self.maybe(0.6) else self.rng.choice(SAYINGS["footer"]), False)
            if self.maybe(0.5):
                self.links(2, 6, True)
            if self.maybe(0.3):
                self.piece("p", self.prose(5, 40), False)
        elif kind == "sidebar":
            for _ in range(self.rng.randint(1, 3)):
                self.links(2, 6, self.maybe(0.4)) if self.maybe(0.6) else self.piece("p", self.prose(4, 40), False)
        elif kind == "advert":
            self.say(self.prose(2, 30), False) if self.maybe(0.6) else self.piece(self.rng.choice(("p", "a", "div")), self.prose(2, 20), False)
        elif kind == "notice":
            self.piece(self.rng.choice(("p", "div", "span")), self.rng.choice(SAYINGS["notice"]) if self.maybe(0.4) else self.prose(4, 40), False)
            if self.maybe(0.6):
                self.piece("button", self.rng.choice(SAYINGS["button"]), False)
        elif kind == "comments":
            nested = self.rng.choice(("article .comment", "div .comment", "li", "li .comment-body", "div .reply"))
            for _ in range(self.rng.randint(1, 6)):
                own = self.open(nested)
                self.piece(self.rng.choice(("span", "b", "div", "cite", "h4")), self.words(1, 2).title(), False)
                for _ in range(self.rng.choice((1, 1, 1, 2, 3))):
                    self.piece(self.rng.choice(("p", "p", "div")), self.prose(2, 80), False)
                if self.maybe(0.4):
                    self.piece("a", "Reply", False, ' href="#"')
                self.close(own)
        elif kind == "form":
            for _ in range(self.rng.randint(1, 3)):
                self.piece("label", self.words(1, 2).capitalize(), False)
                self.out.append('<input type="text" name="x">' if self.maybe(0.7) else f"<select><option>{self.word()}</option><option>{self.word()}</option></select>")
            if self.maybe(0.4):
                self.piece("p", self.prose(3, 20), False)
            self.piece("button", self.rng.choice(SAYINGS["button"]), False)
        elif kind == "related":
            self.links(2, 6, self.maybe(0.3)) if self.maybe(0.8) else self.piece("p", self.prose(3, 30), False)
        self.close(names)

    def main(self) -> None:
        names = self.open(self.rng.choice(CONTAINERS))
        if self.maybe(0.8):
            inner = self.open("header") if self.maybe(0.1) and names and names[-1] in ("article", "main") else []
            self.piece(self.rng.choice(("h1", "h1", "h1", "h2")), self.words(1, 10).capitalize() if self.maybe(0.7) else self.prose(3, 10), True)
            self.close(inner)
        if self.maybe(0.15):
            self.piece(self.rng.choice(("p", "div", "time")), self.words(2, 4).title() + ", 3 May 2024", True)
        for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4, 6, 9, 14))):
            kind = 1.1 * self.rng.random()
            if kind < 0.62:
                self.piece("p", self.prose(1, self.rng.choice((4, 12, 60, 150))), True)
            elif kind < 0.68:
                self.out.append("<p><b>")
                self.say(self.prose(2, 60), True)
                self.out.append("<br>")
            elif kind < 0.74:
                self.piece(self.rng.choice(("h2", "h3", "h4")), self.words(1, 6).capitalize(), True)
            elif kind < 0.79:
                self.tag("ul" if self.maybe(0.6) else "ol")
                for _ in range(self.rng.randint(2, 6)):
                    self.piece("li", self.prose(2, 20), True)
                self.out.append("</ul>" if "<ul" in "".join(self.out[-30:]).lower() else "</ol>")
            elif kind < 0.83:
                self.tag("blockquote")
                self.piece("p", self.prose(3, 40), True)
                self.end("blockquote")
            elif kind < 0.86:
                self.out.append('<figure><img src="a.png">')
                self.piece("figcaption", self.prose(3, 12), True)
                self.out.append("</figure>")
            elif kind < 0.89:
                self.piece("pre", self.words(3, 20), True)
            elif kind < 0.92:
                self.tag("table")
                for _ in range(self.rng.randint(2, 4)):
                    self.tag("tr")
                    for _ in range(2):
                        self.piece("td", self.words(1, 3), True)
                    self.end("tr")
                self.out.append("</table>")
            elif kind < 0.95 and not self.loose:
                self.say(self.prose(5, 80), True)
                self.out.append("<br><br>" if self.maybe(0.5) else "<hr>")
                self.out.append("<p></p>")
            else:
                self.aside(self.rng.choice(("advert", "advert", "related", "notice", "sidebar", "form")))
        for kind in ("related", "comments", "form"):
            if self.maybe(0.12):
                self.aside(kind)
        self.close(names)


def labelled_page(seed: int, number: int) -> tuple[str, str]:
    """(html, main text) of one page; the same for the same numbers."""
    w = Writer(seed, number)
    title = w.words(2, 9)
    w.out.append(f'<!DOCTYPE html><html lang="{w.word()}"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
    bare = w.maybe(0.12)  # a page of nothing but the article
    if w.maybe(0.2):
        w.out.append('<div id="page"><div class="wrapper">')
    for kind, chance in (("notice", 0.25), ("header", 0.5), ("menu", 0.75), ("form", 0.2), ("advert", 0.35), ("sidebar", 0.2)):
        if not bare and w.maybe(chance):
            w.aside(kind)
            if w.maybe(0.2):
                w.out.append(f"<!-- {w.word()} <p>{w.word()}</p> -->")
    if bare or w.maybe(0.96):
        w.main()
    for kind, chance in (("related", 0.3), ("advert", 0.25), ("comments", 0.35), ("form", 0.25), ("sidebar", 0.3), ("menu", 0.15), ("footer", 0.85), ("notice", 0.15)):
        if not bare and w.maybe(chance):
            w.aside(kind)
    if w.maybe(0.8):
        w.out.append("</body></html>")
    return re.sub(r"\s+>", ">", "".join(w.out)), " ".join(w.text)
