"""Generated pages with known main text: what the block labeller learns from, for no table holds labelled blocks.

Layouts, element names, class names and their order vary; the words of articles are random letters, so that the labeller
goes by structure, and boilerplate now and then holds the usual words in four languages.
"""

from __future__ import annotations

import numpy as np

#: Class and id words of page parts; the words in several languages that such parts tend to hold.
NAMES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topbar links tabs toc pagination pager skip",
    "header": "header site masthead top logo branding banner head",
    "aside": "sidebar side aside widget related recommended popular trending more rail secondary teaser tags",
    "ad": "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion banner commercial",
    "notice": "cookie cookies notice consent gdpr alert popup modal paywall overlay disclaimer message subscribe privacy",
    "form": "form search login signup newsletter contact subscribe comment field input",
    "footer": "footer foot bottom copyright legal colophon imprint credits",
    "comments": "comments comment discussion replies reply respond responses disqus reader thread",
    "share": "share social sharing buttons follow author byline meta bio",
    "main": "content main article post entry body story text page blog news single hentry primary detail column center copy",
}
WORDS = "cookies accept privacy policy subscribe newsletter share login search menu home contact about copyright rights reserved comments reply advertisement sponsored related read more datenschutz anmelden suche kontakt impressum kommentare anzeige accueil recherche connexion commentaires publicité inicio buscar contacto comentarios publicidad suscribirse".split()
TAGS = {"nav": ("nav", "div", "ul", "header"), "header": ("header", "div"), "aside": ("aside", "div", "section"), "ad": ("div", "aside", "p", "section"), "notice": ("div", "section", "aside", "dialog", "p"), "form": ("form", "div"), "footer": ("footer", "div", "section"), "comments": ("section", "div", "ol", "aside"), "share": ("div", "ul", "section")}


class PageMaker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def one_of(self, items):
        return items[int(self.rng.integers(len(items)))]

    def words(self, least: int, most: int, usual: float = 0.0) -> str:
        made = []
        for _ in range(int(self.rng.integers(least, most + 1))):
            made.append(self.one_of(WORDS) if self.rng.random() < usual else "".join(chr(97 + k) for k in self.rng.integers(0, 26, int(self.rng.integers(1, 11)))))
        text = " ".join(made)
        return text.capitalize() + (self.one_of([".", "!", "", "."]))

    def attributes(self, kind: str, chance: float = 0.8) -> str:
        if self.rng.random() > chance:
            return ""
        names = NAMES[kind].split()
        value = self.one_of(["-", " ", "_"]).join(self.one_of(names) for _ in range(int(self.rng.integers(1, 3))))
        return f' {self.one_of(["class", "class", "id"])}="{value}"'

    def part(self, kind: str) -> list[tuple[str, int]]:
        """Pieces (markup, label) of one part that is not main text; label -1 is markup alone."""
        tag = self.one_of(TAGS[kind])
        plain = tag in ("div", "p", "ul", "ol", "section")
        out = [(f"<{tag}{self.attributes(kind, 1.0 if plain else 0.4)}>", -1)]
        usual = 0.3 if self.rng.random() < 0.5 else 0.0
        n = int(self.rng.integers(1, 7))
        if kind == "nav" or kind in ("aside", "footer", "share", "header") and self.rng.random() < 0.4:
            out.append(("<ul>" if tag != "ul" else "", -1))
            for _ in range(n):
                link = f'<a href="/x">{self.words(1, 4, usual)}</a>'
                out.append((f"<li>{link}</li>", 0))
            out.append(("</ul>" if tag != "ul" else "", -1))
        elif kind == "form":
            for _ in range(n):
                inner = self.one_of(["label", "p", "button", "div", "legend", "option"])
                out.append((f"<{inner}>{self.words(1, 8, usual)}</{inner}><input>", 0))
        elif kind == "comments":
            out.append((f"<h3>{self.words(1, 4, usual)}</h3>", 0))
            for _ in range(n):
                shell = self.one_of(["div", "article", "li", "div"])
                out.append((f"<{shell}{self.attributes('comments')}>", -1))
                out += [(f"<p>{self.words(2, 60)}</p>", 0) for _ in range(int(self.rng.integers(1, 4)))]
                out.append((f"</{shell}>", -1))
        else:
            for _ in range(int(self.rng.integers(1, 4))):
                text = self.words(1, 25, usual)
                out.append(((text if tag == "p" or self.rng.random() < 0.4 else f"<p>{text}</p>"), 0))
                if tag == "p":
                    break
                out.append(("<hr>", -1))
        return [*out, (f"</{tag}>", -1)]

    def main(self) -> list[tuple[str, int]]:
        shells = []
        top = self.one_of(["article", "article", "main", "div", "section", "td"])
        shells.append(f"{top}{self.attributes('main', 1.0 if top in ('div', 'td', 'section') else 0.3)}")
        for _ in range(int(self.rng.integers(0, 3))):
            inner = self.one_of(["div", "section", "article", "div"])
            shells.append(f"{inner}{self.attributes('main', 0.6)}")
        out = [("<table><tr>" if top == "td" else "", -1), *[(f"<{s}>", -1) for s in shells]]
        if self.rng.random() < 0.85:
            out.append((f"<h1>{self.words(1, 12)}</h1>", 1))
        for _ in range(int(self.rng.integers(0, 18))):
            k = self.rng.random()
            text = self.words(1, int(self.one_of([1, 3, 8, 30, 120])), 0.3 if self.rng.random() < 0.1 else 0.0)
            if k < 0.6:
                bold = "<b>" if self.rng.random() < 0.15 else ""
                out.append((f"<p>{bold}{text}" + ("</p>" if self.rng.random() < 0.8 else ""), 1))
            elif k < 0.7:
                out.append((f"<{(h := self.one_of(['h2', 'h3', 'h4']))}>{text}</{h}>", 1))
            elif k < 0.78:
                out += [("<ul>", -1), *[(f"<li>{self.words(1, 20)}</li>", 1) for _ in range(3)], ("</ul>", -1)]
            elif k < 0.84:
                out.append((f"<{(q := self.one_of(['blockquote', 'pre', 'div', 'figcaption']))}>{text}</{q}>", 1))
            elif k < 0.88:
                out += [("<table>", -1), *[(f"<tr><td>{self.words(1, 4)}</td>", 1) for _ in range(3)], ("</table>", -1)]
            else:
                out += self.part(self.one_of(["ad", "notice", "share", "aside", "form"]))
        return [*out, *[(f"</{s.split()[0]}>", -1) for s in reversed(shells)], ("</tr></table>" if top == "td" else "", -1)]

    def page(self) -> tuple[str, list[int]]:
        """A page and the labels of its blocks, 1 for main text."""
        before = [k for k in ("notice", "header", "nav", "ad", "aside", "form") if self.rng.random() < 0.45]
        after = [k for k in ("share", "ad", "aside", "comments", "form", "notice", "footer") if self.rng.random() < 0.45]
        self.rng.shuffle(before)
        pieces = [p for k in before for p in self.part(k)] + (self.main() if self.rng.random() < 0.95 else []) + [p for k in after for p in self.part(k)]
        shell = self.one_of(["", "", "div", "div"])
        open_, close = (f'<{shell} class="{self.one_of(["wrapper", "container", "page", "site", "layout"])}">', f"</{shell}>") if shell else ("", "")
        body = "".join(p for p, _ in pieces)
        return f"<html><head><title>t</title></head><body>{open_}{body}{close}</body></html>", [y for p, y in pieces if y >= 0]
