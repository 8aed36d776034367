"""Labelled pages to train a block labeller on: landmarks of given pages, and pages drawn in many layouts."""

from __future__ import annotations

import html as markup

from cairn.llm.html_blocks import Block, leaf_blocks

# Elements that hold, and that never hold, the main text; class words and stock phrases of the web.
HOLDS = frozenset("article main".split())
NEVER = frozenset("nav header footer aside form menu dialog".split())
CLASSES = {
    "text": "content article post entry story main body text page prose copy article-body post-content entry-content main-content",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu site-nav toolbar tabs pagination",
    "header": "header masthead site-header page-header topbar branding logo-bar hero-top",
    "footer": "footer site-footer colophon bottom copyright legal page-footer foot",
    "side": "sidebar side aside widget related rail more-stories recommended popular trending tags share social",
    "notice": "notice cookie cookies consent banner cookie-banner alert gdpr popup modal newsletter overlay paywall message",
    "advert": "ad ads advert advertisement sponsored promo sponsor ad-slot adbox banner-ad commercial",
    "form": "form search login signup subscribe contact search-box comment-form register feedback",
    "comments": "comments comment replies discussion responses reader-comments comment-list thread disqus reactions",
}
PHRASES = {
    "nav": "Home|About us|Contact|News|Sport|Products|Services|Blog|Shop|Login|Start|Über uns|Kontakt|Nachrichten|Accueil|À propos|Actualités|Inicio|Quiénes somos|Noticias|Next|Previous|Archive|Help|FAQ",
    "header": "Daily News|The Gazette|Your source for everything|Welcome|Breaking news|Willkommen|Bienvenue|Bienvenidos|Skip to content|Search this site|Open menu",
    "footer": "© 2024 All rights reserved.|Copyright|Privacy policy|Terms of use|Impressum|Datenschutz|Mentions légales|Aviso legal|Imprint|Powered by|Follow us|Alle Rechte vorbehalten.|Tous droits réservés.|Todos los derechos reservados.|Sitemap",
    "side": "Related articles|Most read|Popular posts|Read more|Share|Tweet|Tags|Recommended for you|Mehr zum Thema|Meistgelesen|À lire aussi|Les plus lus|Lo más leído|Recent posts|Categories|Archives",
    "notice": "We use cookies to improve your experience.|Accept all|This site uses cookies.|Please enable JavaScript.|Subscribe to our newsletter!|Wir verwenden Cookies.|Alle akzeptieren|Nous utilisons des cookies.|Tout accepter|Usamos cookies.|Aceptar todo|You have 3 free articles left.|Sign up now",
    "advert": "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now and save 50%!|Special offer|Limited time only.|Shop the sale|Jetzt kaufen|Achetez maintenant|Compra ahora|Promoted content",
    "form": "Name|Email|Your message|Send|Submit|Search|Password|Remember me|Forgot password?|E-Mail|Absenden|Suche|Envoyer|Rechercher|Enviar|Buscar|Leave a reply|Post comment",
    "comments": "Comments|3 comments|Reply|Report|Like|2 hours ago|says:|Kommentare|Antworten|Commentaires|Répondre|Comentarios|Responder|Great article!|Thanks for sharing.|I don't agree at all.|First!|Log in to comment",
}
_LIKE_ARTICLE, _OTHER = "\ue001", "\ue002"  # marks that a drawn page's blocks carry until they are labelled
_FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def landmark_label(blocks: list[Block]) -> list[int] | None:
    """1 for blocks in an article or main element but in nothing within it that never holds main text; null without such an element."""
    out = []
    for b in blocks:
        names = [level[0] for level in b.path]
        at = max((i for i, n in enumerate(names) if n in HOLDS), default=-1)
        out.append(int(at >= 0 and not NEVER.intersection(names[at:])))
    return out if any(out) else None


class _Draw:
    def __init__(self, rng, pool: list[str]):
        self.rng, self.pool = rng, pool
        self.told = rng.random() < 0.75  # do class words tell what they hold?
        self.landmarks = rng.random() < 0.6

    def one(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, n: int) -> list[str]:
        out: list[str] = []
        while len(out) < n:
            source = self.one(self.pool).split(" ") if self.pool and self.chance(0.9) else _FILLER
            start = int(self.rng.integers(len(source)))
            out += source[start:start + n - len(out)]
        return out

    def prose(self, low: int, high: int) -> str:
        n = int(low * (high / low) ** self.rng.random())
        text = " ".join(self.words(max(1, n)))
        return text if text[-1] in ".!?" or self.chance(0.15) else text + "."

    def short(self, kind: str) -> str:
        return self.one(PHRASES[kind].split("|")) if self.chance(0.6) else " ".join(self.words(int(self.rng.integers(1, 5))))

    def leaf(self, mark: str, name: str, text: str, link: bool = False) -> str:
        text = mark + markup.escape(text, quote=False)
        if link:
            text = f'<a href="#">{text}</a>'
        elif self.chance(0.15):
            text = f"<b>{text}" if self.chance(0.5) else f"<em>{text}</em>"
        return f"<{name}>{text}" if name in ("p", "li") and self.chance(0.15) else f"<{name}>{text}</{name}>"

    def wrapped(self, kind: str, name: str, inner: str) -> str:
        if not self.landmarks or self.chance(0.15):
            name = "div" if self.chance(0.8) else "section"
        marks = self.one(CLASSES[kind].split()) if self.told and self.chance(0.85) else self.one(["", "box", "row", "col", "wrap", "c1", "block", "inner"])
        if marks and self.chance(0.3):
            marks += " " + self.one(["row", "clear", "c2", "wide", "x7", "container"])
        return f'<{name}{f" {self.one(["class", "class", "id"])}={chr(34)}{marks}{chr(34)}" if marks else ""}>{inner}</{name}>'

    def links(self, kind: str, low: int, high: int) -> str:
        items = [self.leaf(_OTHER, "li", self.short(kind), link=self.chance(0.9)) for _ in range(int(self.rng.integers(low, high)))]
        return f"<ul>{''.join(items)}</ul>"

    def other(self, kind: str) -> str:
        many = int(self.rng.integers(1, 4))
        if kind == "nav":
            return self.wrapped(kind, "nav", self.links(kind, 2, 12))
        if kind == "header":
            return self.wrapped(kind, "header", "".join(self.leaf(_OTHER, self.one(["h1", "h2", "p", "div"]), self.short(kind), self.chance(0.5)) for _ in range(many)))
        if kind == "footer":
            inner = "".join(self.leaf(_OTHER, self.one(["p", "div", "span"]), self.short(kind) if self.chance(0.5) else self.prose(3, 25), self.chance(0.3)) for _ in range(many))
            return self.wrapped(kind, "footer", inner + (self.links(kind, 2, 8) if self.chance(0.4) else ""))
        if kind == "side":
            inner = self.leaf(_OTHER, self.one(["h2", "h3", "h4"]), self.short(kind)) if self.chance(0.7) else ""
            inner += self.links(kind, 2, 9) if self.chance(0.6) else "".join(self.leaf(_OTHER, "p", self.prose(4, 40), self.chance(0.5)) for _ in range(many))
            return self.wrapped(kind, "aside", inner)
        if kind == "form":
            inner = "".join(f"<label>{_OTHER}{self.short(kind)}</label><input>" if self.chance(0.5) else self.leaf(_OTHER, self.one(["p", "div", "button", "legend"]), self.short(kind)) for _ in range(many + 1))
            return self.wrapped(kind, "form", f"<form>{inner}</form>" if self.chance(0.6) else inner)
        if kind == "comments":
            rows = ""
            for _ in range(int(self.rng.integers(1, 7))):
                rows += self.wrapped(kind, "div", self.leaf(_OTHER, self.one(["p", "div", "h4"]), self.short(kind)) + "".join(self.leaf(_OTHER, "p", self.prose(4, 60)) for _ in range(int(self.rng.integers(1, 3)))))
            return self.wrapped(kind, "section", self.leaf(_OTHER, self.one(["h2", "h3"]), self.one(PHRASES[kind].split("|"))) + rows)
        inner = "".join(self.leaf(_OTHER, self.one(["p", "div", "span", "h3"]), self.short(kind) if self.chance(0.5) else self.prose(3, 40), self.chance(0.2)) for _ in range(many))
        return self.wrapped(kind, "div", inner)

    def article(self) -> str:
        inner = self.leaf(_LIKE_ARTICLE, self.one(["h1", "h1", "h2"]), " ".join(self.words(int(self.rng.integers(2, 14))))) if self.chance(0.85) else ""
        parts = 1 if self.chance(0.12) else int(2 * 15 ** self.rng.random()) if self.chance(0.93) else int(self.rng.integers(40, 90))
        inside = self.one(["advert", "side", "notice", "form", "comments"])
        for i in range(parts):
            what = self.rng.random()
            if what < 0.72:
                inner += self.leaf(_LIKE_ARTICLE, "p" if self.chance(0.9) else "div", self.prose(2, 150))
            elif what < 0.82:
                inner += self.leaf(_LIKE_ARTICLE, self.one(["h2", "h3"]), " ".join(self.words(int(self.rng.integers(1, 8)))))
            elif what < 0.9:
                inner += "<ul>" + "".join(self.leaf(_LIKE_ARTICLE, "li", self.prose(1, 25)) for _ in range(int(self.rng.integers(2, 6)))) + "</ul>"
            elif what < 0.95:
                inner += f"<blockquote>{self.leaf(_LIKE_ARTICLE, 'p', self.prose(5, 60))}</blockquote>"
            else:
                inner += "<table>" + "".join("<tr>" + "".join(self.leaf(_LIKE_ARTICLE, "td", self.prose(1, 5)) for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
            if i + 1 < parts and self.chance(0.04):
                inner += self.other(inside)
        if self.landmarks and self.chance(0.7):
            return self.wrapped("text", self.one(["article", "article", "main"]), inner)
        return self.wrapped("text", "div", inner)


def draw_page(rng, pool: list[str]) -> tuple[list[Block], list[int]]:
    """Blocks of a drawn page and their labels; words are mostly those of ``pool``."""
    d = _Draw(rng, pool)
    before = [k for k, p in (("notice", 0.3), ("header", 0.5), ("nav", 0.7), ("form", 0.2), ("advert", 0.4), ("side", 0.15)) if d.chance(p)]
    after = [k for k, p in (("side", 0.4), ("advert", 0.3), ("comments", 0.4), ("form", 0.25), ("side", 0.2), ("nav", 0.1), ("footer", 0.75), ("notice", 0.2)) if d.chance(p)]
    if d.chance(0.2):
        before = [before[k] for k in rng.permutation(len(before))]
    body = "".join(map(d.other, before)) + d.article() + "".join(map(d.other, after))
    for _ in range(int(rng.integers(0, 3))):
        body = f"<div>{body}</div>"
    blocks, labels = [], []
    for b in leaf_blocks(f"<html><body>{body}</body></html>"):
        labels.append(int(_LIKE_ARTICLE in b.text))
        text = " ".join(b.text.replace(_LIKE_ARTICLE, "").replace(_OTHER, " ").split())
        blocks.append(b._replace(text=text or "x"))
    return blocks, labels
