"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page falls into leaf blocks, the runs of text between the borders of block elements.  Each
has features of its ancestors (tags, words of classes, ids and roles), of its text
(length, share of links, sentence and copyright signs, boilerplate words) and of its neighbours.  Of the
labels content and other the field takes the likeliest sequence (Viterbi), and content blocks make the text.

The field is trained on labelled pages of two kinds: pages that a generator dresses in
many templates, of which it knows the content; and at most `sample` pages of the table, of up to
SAMPLE_CHARS characters, that mark their article by its element, where that is the label.  The sample takes the pages of
the smallest hashes, so it depends on the table alone.  Training maximises the regularised likelihood in numpy.

What no reader sees in the text is left out before: scripts, styles, comments, titles, fields of forms, embedded objects.

Nulls: a null page counts as empty and has an empty text, as has one without content.  Broken markup never fails: what is not closed ends with
its parent, an unclosed comment or script takes the rest, a lone `<` is text.  White space is what str.split splits at.  A
`br` is white space.  Repeated rows each give a row.  Pages are read whole, whatever their length.  An empty table gives an empty result.
Only the id, the url and the html are read; other columns may have any name.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, table

#: Longest page that the training sample takes.
SAMPLE_CHARS = 1 << 16

# Elements of HTML by kind.
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p
pre search section summary table tbody td tfoot th thead tr ul
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left out with all that is in them.  RAW ones hold text up to their end tag, whatever it looks like.
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
HIDDEN_TAGS = frozenset("audio button canvas datalist map noscript object optgroup option select svg template video".split())
#: An element of the key ends an open one of the value, up to the borders.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th"), "tfoot": ("tr", "td", "th")}
BORDERS = frozenset("ul ol menu dl table body html".split())
#: Ancestors that say something by their tag.
TELLING = frozenset("address article aside blockquote details dialog dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main menu nav ol p pre section table td th ul".split())

PARTS = frozenset("in:article in:aside in:details in:dialog in:footer in:form in:header in:hidden in:main in:menu in:nav".split())

# Words that short blocks of boilerplate hold.
CUES = frozenset("""
abonnieren accept accueil advert advertisement anzeige archives aviso categories click comment comentarios commentaires comments contact contacto cookie cookies copyright datenschutz decline email
facebook impressum imprint inicio javascript kommentare kontakt legal login menu newsletter password policy popular posted powered privacy publicidad publicité related reply reserved share sitemap
sponsored startseite submit subscribe suscribirse tags terms tweet
""".split())

_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW_TAGS}
_SIGNS = re.compile(r"[.!?…:;]['\"”»)]*$")


class Block:
    __slots__ = ("around", "linked", "tag", "text", "started")

    def __init__(self, text: str, tag: str, around: tuple[str, ...], linked: int, started: bool):
        self.text, self.tag, self.around, self.linked, self.started = text, tag, around, linked, started


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): `text`, `open` and `close` in page order, hidden text left out."""
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], ""
            return
        if mark > at:
            yield "text", page[at:mark], ""
        after = page[mark + 1 : mark + 2]
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 2)
            at = size if end < 0 else end + 3
        elif after in "!?/" and after and (after != "/" or mark + 2 < size):
            end = page.find(">", mark)
            end = size if end < 0 else end
            if after == "/" and page[mark + 2 : mark + 3].isalpha():
                yield "close", page[mark + 2 : end].split(None, 1)[0].rstrip("/").lower(), ""
            at = end + 1
        elif after.isascii() and after.isalpha():
            found = _TAG.match(page, mark)
            if found:
                name, attributes, at = found[1].lower(), found[2], found.end()
            else:  # a quote that nothing closes
                end = page.find(">", mark)
                end = size if end < 0 else end
                name, attributes, at = re.match(r"[^\s/>]+", page[mark + 1 : end])[0].lower(), "", end + 1
            if name in RAW_TAGS:
                end = _RAW_END[name].search(page, at)
                at = size if end is None else end.start()
            yield "open", name, attributes
        else:
            yield "text", "<", ""
            at = mark + 1


def _told(name: str, attributes: str) -> tuple[str, ...]:
    """Features that an element gives to what is in it; those of the whole page say nothing."""
    if name in ("html", "body"):
        return ()
    out = [f"in:{name}"] if name in TELLING else []
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key in ("hidden", "aria-hidden", "style"):
            if key == "hidden" or key == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", ""):
                out.append("in:hidden")
        else:
            out += [f"name:{x.lower().removesuffix('s')}" for x in _NAME.findall(value)]
    return tuple(dict.fromkeys(out))


def _near(stack: list[tuple[str, tuple[str, ...]]]) -> list[str]:
    """What the two innermost elements that are parts of a page say; `plain` if there is none."""
    out: list[str] = []
    sides = ["near", "then"]
    for _, own in reversed(stack[-32:]):
        if found := [x for x in own if x.startswith("name:") or x in PARTS]:
            side = sides.pop(0)
            out += [f"{side}:{x}" for x in found]
            if not sides:
                break
    return out or ["plain"]


def leaf_blocks(page: str) -> list[Block]:
    """The runs of text between borders of block elements, in page order, those without text left out."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    names, told = Counter(), Counter()
    out, parts, linked, hidden, around, started = [], [], 0, 0, None, False

    def flush() -> None:
        nonlocal parts, linked, around
        text = " ".join("".join(parts).split())
        if text:
            if around is None:
                around = (*told, *_near(stack))
            out.append(Block(text, next((x for x, _ in reversed(stack[-8:]) if x in BLOCK_TAGS), ""), around, linked, started))
        parts, linked = [], 0

    def pop() -> None:
        nonlocal hidden, around
        name, own = stack.pop()
        names[name] -= 1
        hidden -= name in HIDDEN_TAGS or name in RAW_TAGS
        for x in own:
            told[x] -= 1
            if not told[x]:
                del told[x]
        around = None if own else around

    def close(wanted: tuple[str, ...], borders: frozenset[str]) -> None:
        """Pop to the innermost of the wanted elements, if it stands within the borders."""
        if any(names[x] for x in wanted):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in wanted:
                    flush()
                    while len(stack) > i:
                        pop()
                    return
                if stack[i][0] in borders:
                    return

    for kind, value, attributes in _pieces(page):
        if kind == "text":
            if not hidden:
                value = entities.unescape(value)
                parts.append(value)
                if names["a"]:
                    linked += len(value.strip())
        elif kind == "open":
            if value == "br":
                parts.append(" ")
            if value in BLOCK_TAGS:
                close(("p",), BORDERS)
                flush()
                close(ENDS.get(value, ()), BORDERS)
                started = started or value == "h1"
            if value in VOID_TAGS or attributes.endswith("/") and value not in BLOCK_TAGS and value not in RAW_TAGS:
                continue
            own = _told(value, attributes)
            stack.append((value, own))
            names[value] += 1
            hidden += value in HIDDEN_TAGS or value in RAW_TAGS
            for x in own:
                told[x] += 1
            around = None if own else around
        elif value in BLOCK_TAGS and value not in ("body", "html"):
            flush()
            close((value,), frozenset())
        elif names[value]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == value:
                    if any(x in BLOCK_TAGS for x, _ in stack[i + 1 : i + 9]) and value not in HIDDEN_TAGS and value not in RAW_TAGS:
                        above = stack[i + 1 :]
                        while len(stack) > i:
                            pop()
                        for name, own in above:  # an inline element ends within blocks that go on
                            stack.append((name, own))
                            names[name] += 1
                            hidden += name in HIDDEN_TAGS or name in RAW_TAGS
                            told.update(own)
                        around = None
                    else:
                        while len(stack) > i:
                            pop()
                    break
    flush()
    return out


def _length(block: Block) -> str:
    return str(min(7, (block.text.count(" ") + 1).bit_length()))


def _without_page_form(blocks: list[Block]) -> None:
    """A form around most of a page's text is no form to fill in."""
    within = sum(len(x.text) for x in blocks if "in:form" in x.around)
    if 2 * within > sum(len(x.text) for x in blocks):
        for x in blocks:
            x.around = tuple(y for y in x.around if y != "in:form")


def features(blocks: list[Block]) -> list[list[str]]:
    """The names of each block's features; equal ancestors share one tuple of names."""
    _without_page_form(blocks)
    most = max((len(x.text) for x in blocks), default=1)
    out = []
    for i, x in enumerate(blocks):
        words = x.text.count(" ") + 1
        share = x.linked / len(x.text)
        own = [
            "all", f"tag:{x.tag}", f"long:{_length(x)}", f"linked:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"sentence:{bool(_SIGNS.search(x.text))}",
            f"started:{x.started}", f"part:{8 * i // len(blocks)}", f"most:{min(3, int(4 * len(x.text) / most))}", f"commas:{min(2, x.text.count(','))}"]
        own += [f"{side}:{_length(y)}" for side, y in (("before", blocks[i - 1] if i else None), ("after", blocks[i + 1] if i + 1 < len(blocks) else None)) if y]
        if "©" in x.text or "(c)" in x.text:
            own.append("copyright")
        if words <= 16:
            own += [f"word:{w}" for w in sorted(CUES.intersection(re.findall(r"[^\W\d_]+", x.text.lower())))]
        out.append([*own, *x.around])
    return out


class Field:
    """Weights of features for content (against other), of label pairs, and of the first label."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = weights, pairs, first

    def labels(self, blocks: list[Block]) -> list[bool]:
        """The likeliest sequence: which blocks are content.  On ties, other."""
        if not blocks:
            return []
        get, shared = self.weights.get, {}
        (oo, oc), (co, cc) = self.pairs.tolist()
        other, content = self.first.tolist()
        back = []
        for i, (x, own) in enumerate(zip(blocks, features(blocks), strict=True)):
            if (held := shared.get(x.around)) is None:
                held = shared[x.around] = sum(get(y, 0.0) for y in x.around)
            score = held + sum(get(y, 0.0) for y in own[: len(own) - len(x.around)])
            if i:
                back.append((content + co > other + oo, content + cc > other + oc))
                other, content = max(other + oo, content + co), max(other + oc, content + cc)
            content += score
        label, out = content > other, []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return [*reversed([*out, label])]


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 150, ridge: float = 0.3, least: int = 3) -> Field:
    """The field of greatest regularised likelihood: forward and backward sums over all pages at once, steps by Adam.

    Features that fewer than `least` blocks have are left out.
    """
    pages = [x for x in pages if x[0]]
    named_ = [features(x) for x, _ in pages]
    often = Counter(y for page in named_ for own in page for y in own)
    number = {x: i for i, x in enumerate(sorted(k for k, n in often.items() if n >= least))}
    longest, count = max(map(len, named_), default=1), len(pages)
    rows, columns, truth, there = [], [], np.zeros((count, longest), bool), np.zeros((count, longest), bool)
    for p, (page, labels) in enumerate(zip(named_, (y for _, y in pages), strict=True)):
        there[p, : len(page)], truth[p, : len(page)] = True, labels
        for t, own in enumerate(page):
            found = [number[y] for y in own if y in number]
            rows += [p * longest + t] * len(found)
            columns += found
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    size, both = len(number), there[:, 1:]
    theta = np.zeros(size + 6)  # weights, pairs [from, to], first
    seen_pairs = np.array([[(both & (truth[:, :-1] == a) & (truth[:, 1:] == b)).sum() for b in (False, True)] for a in (False, True)], float)
    seen = np.concatenate([np.bincount(columns, truth.ravel()[rows], size), seen_pairs.ravel(), [(~truth[:, 0]).sum(), truth[:, 0].sum()]])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        score = np.bincount(rows, theta[columns], count * longest).reshape(count, longest)
        pairs, first = theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        emitted = np.stack([np.zeros_like(score), score], axis=2)
        ahead = np.zeros((count, longest, 2))
        ahead[:, 0] = first + emitted[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(ahead[:, t - 1, :1] + pairs[0], ahead[:, t - 1, 1:] + pairs[1]) + emitted[:, t]
            ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind, expected = np.zeros((count, 2)), np.zeros((2, 2))
        chance = np.zeros((count, longest))
        for t in range(longest - 1, -1, -1):
            chance[:, t] = np.where(there[:, t], np.exp(np.minimum(ahead[:, t, 1] + behind[:, 1] - total, 0)), 0)
            if t:
                own = emitted[:, t] + behind
                joint = np.exp(np.minimum(ahead[:, t - 1, :, None] + pairs + own[:, None] - total[:, None, None], 0))
                expected += joint[there[:, t]].sum(axis=0)
                behind = np.where(there[:, t, None], np.logaddexp(pairs[:, 0] + own[:, :1], pairs[:, 1] + own[:, 1:]), behind)
        slope = seen - np.concatenate([np.bincount(columns, chance.ravel()[rows], size), expected.ravel(), [(1 - chance[:, 0]).sum(), chance[:, 0].sum()]]) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + 0.1 * (1 - step / (rounds + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Field({x: float(theta[i]) for x, i in number.items()}, theta[size : size + 4].reshape(2, 2), theta[size + 4 :])


#: Starts each content block of a generated page; a private code point.
MARK = ""

# Fixed values of the generator: names and phrases of page parts.
NAMES = {
    "content": "article post entry content story main-content post-body article-body entry-content text body-copy page-content articleBody rich-text prose",
    "menu": "nav navbar menu main-menu navigation topnav site-nav breadcrumbs breadcrumb pagination pager toc links",
    "header": "header site-header masthead topbar banner branding logo",
    "footer": "footer site-footer colophon copyright legal bottom credits",
    "sidebar": "sidebar side widget widget-area related related-posts recommended rail popular trending more-stories",
    "notice": "cookie cookie-banner consent gdpr notice alert popup modal overlay paywall disclaimer announcement message",
    "advert": "ad ads advert advertisement ad-slot sponsored sponsor promo promotion banner-ad adsbygoogle affiliate",
    "form": "form newsletter signup subscribe search search-form login contact-form subscription",
    "comments": "comments comment comment-list discussion responses replies disqus reader-comments user-comments",
    "share": "share social social-links sharing tags post-meta meta byline author-box",
}
PHRASES = {
    "menu": "Home|About|About us|Contact|News|Blog|Products|Services|Login|Sign in|Archive|Next|Previous|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Contacto|Sitemap|Shop|Help|FAQ",
    "header": "Skip to content|Menu|The Daily Paper|Welcome|Search|My Site|Breaking news|Subscribe|Zum Inhalt springen|Aller au contenu|Saltar al contenido",
    "footer": "© 2024 All rights reserved.|Copyright 2023 Example Inc.|Privacy policy|Terms of use|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by Example|Imprint|Cookie settings|All rights reserved",
    "sidebar": "Related articles|Popular posts|Most read|Recent posts|Categories|Tags|Archives|You may also like|More from this author|Follow us|Mehr zum Thema|À lire aussi|Te puede interesar",
    "notice": "We use cookies to improve your experience.|This site uses cookies. Accept all|By continuing you agree to our cookie policy.|Accept|Decline|Please enable JavaScript.|Wir verwenden Cookies.|Nous utilisons des cookies.|Usamos cookies.|You have 3 free articles left.|Subscribe to continue reading",
    "advert": "Advertisement|Sponsored|Buy now and save 50%!|Anzeige|Publicité|Publicidad|Limited offer, shop today.|Click here for great deals|Ad|Best prices guaranteed!",
    "form": "Sign up for our newsletter|Your email|Name|Email address|Submit|Search|Enter your email|Leave a reply|Post comment|Password|Forgot password?|Newsletter abonnieren|Suscribirse",
    "comments": "Comments|Reply|Leave a comment|3 comments|Great post, thanks!|I disagree with this.|Kommentare|Commentaires|Comentarios|says:|2 days ago|Log in to comment|Report|Like",
    "share": "Share|Tweet|Share on Facebook|Share this article|Print|Email|Tags:|By|Published|Teilen|Partager|Compartir|5 min read|Posted in",
}


def _sentence(rng: random.Random, words: int) -> str:
    out = ["".join(rng.choice("aeiou") if i % 2 else rng.choice("bdfghklmnprstvw") for i in range(rng.randint(1, 9))) for _ in range(words)]
    text = " ".join(w + ("," if rng.random() < 0.06 else "") for w in out[:-1]) + (" " if words > 1 else "") + out[-1]
    return text.capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def _paragraph(rng: random.Random) -> str:
    return " ".join(_sentence(rng, rng.randint(1, 25)) for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8])))


def _content(rng: random.Random) -> str:
    """Blocks of an article, each with MARK."""
    out = []
    if (how := rng.random()) < 0.75:
        title = f"<{(tag := 'h1' if how < 0.6 else 'h2')}>{MARK}{_sentence(rng, rng.randint(1, 12))}</{tag}>"
        out.append(f"<header>{title}{_part(rng, 'share') if rng.random() < 0.3 else ''}</header>" if rng.random() < 0.3 else title)
    for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 7, 12, 20])):
        kind, text = rng.random(), MARK + _paragraph(rng)
        if rng.random() < 0.15:
            text += f' <a href="#">{_sentence(rng, 3)}</a> {_sentence(rng, 4)}'
        if kind < 0.66:
            out.append(f"<p>{text}</p>" if rng.random() < 0.8 else f"<p>{text}")
        elif kind < 0.73:
            out.append(f"<h{(n := rng.randint(2, 4))}>{MARK}{_sentence(rng, rng.randint(1, 7))}</h{n}>")
        elif kind < 0.80:
            out.append("<ul>" + "".join(f"<li>{MARK}{_sentence(rng, rng.randint(1, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.85:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.89:
            out.append(f"<pre>{text}</pre>")
        elif kind < 0.92:
            out.append(f'<figure><img src="x.jpg"><figcaption>{MARK}{_sentence(rng, rng.randint(3, 12))}</figcaption></figure>')
        elif kind < 0.95:
            out.append("<table>" + "".join(f"<tr><td>{MARK}{_sentence(rng, 2)}</td><td>{MARK}{_sentence(rng, 1)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        else:
            out.append(f"<div>{text}</div>")
        if rng.random() < 0.12:
            out.append(_part(rng, rng.choice(["advert", "advert", "share", "sidebar", "form", "notice"])))
    return "".join(out)


def _part(rng: random.Random, kind: str) -> str:
    """A part of a page that is not content."""
    said = lambda: rng.choice(PHRASES[kind].split("|")) if rng.random() < 0.6 else _sentence(rng, rng.randint(1, 6))
    link = lambda x: f'<a href="/{rng.randint(1, 99)}">{x}</a>'
    if kind in ("menu", "sidebar", "footer", "share") and rng.random() < 0.7:
        inner = "<ul>" + "".join(f"<li>{link(said())}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"
        if kind in ("sidebar", "footer"):
            inner = f"<h{(n := rng.randint(2, 4))}>{said()}</h{n}>" * (rng.random() < 0.5) + inner + f"<p>{said()} {_paragraph(rng)}</p>" * (rng.random() < 0.4)
    elif kind == "comments":
        one = lambda: rng.choice([
            f"<div class='comment'><b>{_sentence(rng, 2)}</b><p>{_paragraph(rng)}</p></div>", f"<li><p>{_paragraph(rng)}</p>{link('Reply')}</li>", f"<article class='comment-body'><p>{_paragraph(rng)}</p></article>",
            f"<article><p>{_paragraph(rng)}</p></article>", f"<p>{_paragraph(rng)}</p>", f"<div><p>{_paragraph(rng)}</p><p>{_paragraph(rng)}</p></div>"])
        inner = f"<h{(n := rng.randint(2, 4))}>{said()}</h{n}>" + "".join(one() for _ in range(rng.randint(1, 6))) + f"<form><label>{said()}</label><input name=c></form>" * (rng.random() < 0.4)
    elif kind == "form":
        inner = f"<p>{said()} {_sentence(rng, 8)}</p>" * (rng.random() < 0.6) + f"<label>{said()}</label><input name='q'><button>{said()}</button>"
    else:
        inner = rng.choice([f"<p>{said()} {_paragraph(rng)}</p>", f"<p>{_paragraph(rng)}</p><p>{_paragraph(rng)}</p>", _paragraph(rng), f"<h1>{said()}</h1>", f"<p>{said()}</p>", said(), f"{_sentence(rng, rng.randint(3, 14))} {_sentence(rng, 6)}", f"<div>{said()}</div>{link(said())}"])
    tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section", "advert": "aside"}.get(kind, "div")
    name = rng.choice(NAMES[kind].split())
    how = rng.random()
    if how < 0.3 and tag != "div" and tag != "section":
        return f"<{tag}>{inner}</{tag}>"
    if how < 0.5 and tag != "div":
        return f'<{tag} class="{name}">{inner}</{tag}>'
    return f'<div {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", " x" + str(rng.randint(1, 9)), "-wrap", "_box"])}">{inner}</div>'


def generated(count: int, seed: int = 13) -> list[str]:
    """Pages of many templates; content blocks begin with MARK."""
    out = []
    for i in range(count):
        rng = random.Random(f"{seed}-{i}")
        some = lambda kind, p: _part(rng, kind) if rng.random() < p else ""  # noqa: E731, B023
        inner = _content(rng)
        how, name = rng.random(), rng.choice(NAMES["content"].split())
        after = some("share", 0.3) + some("comments", 0.35) + some("advert", 0.15)
        if how < 0.3:
            inner = f"<article>{inner}{after if rng.random() < 0.5 else ''}</article>{after if rng.random() < 0.5 else ''}"
        elif how < 0.42:
            inner = f"<main>{inner}</main>{after}"
        elif how < 0.78:
            inner = f'<{(tag := rng.choice(["div", "div", "section"]))} {rng.choice(["class", "id"])}="{name}{rng.choice(["", "", "-wrap", "_box", " x1"])}">{inner}</{tag}>{after}'
        elif how < 0.83:
            inner = f"<table><tr><td>{some('menu', 0.7)}</td><td>{inner}</td></tr></table>{after}"
        elif how < 0.9:
            inner = f"<div>{inner}</div>{after}"
        else:
            inner += after
        before = some("notice", 0.25) + some("header", 0.5) + some("menu", 0.7) + some("advert", 0.3) + some("form", 0.15) + some("sidebar", 0.15)
        behind = some("sidebar", 0.4) + some("advert", 0.2) + some("form", 0.2) + some("comments", 0.1) + some("footer", 0.8) + some("notice", 0.15)
        if rng.random() < 0.3:
            within = rng.choice(["main", "main", f'div class="{rng.choice(NAMES["content"].split())}"', 'div id="main"', "section"])
            inner = f"<{within}>{inner}{some('sidebar', 0.3)}</{within.split()[0]}>"
        if rng.random() < 0.3:
            inner = f'<div id="{rng.choice(["page", "wrapper", "container", "wrap", "box", "outer"])}"><section>{inner}</section></div>'
        if rng.random() < 0.03:
            inner = f'<form action="/" id="page">{inner}</form>'
        if (how := rng.random()) < 0.1:
            before = behind = ""
        elif how < 0.13:
            inner = ""
        out.append(f"<html><head><title>{_sentence(rng, 4)}</title><style>p{{}}</style></head><body>{before}{inner}{behind}<script>var t='<p>x</p>';</script></body></html>")
    return out


#: Names of parts within an article that are none of it, for labels by elements.
OTHER = {f"name:{x}" for kind, names in NAMES.items() if kind != "content" for x in re.findall("[a-z]+", names.replace("-wrap", "")) if x not in ("body", "text", "main", "header", "post", "story", "stories", "more", "page")}
OTHER |= {f"name:{x.removeprefix('name:').removesuffix('s')}" for x in OTHER} | {"in:nav", "in:footer", "in:aside", "in:form", "in:hidden", "in:dialog"}


def labelled_pages(marked: list[str], sampled: list[str]) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels: of generated pages by MARK, of sampled ones by their article or main element; pages without one are left out."""
    out = []
    for page in marked:
        blocks = leaf_blocks(page)
        labels = [MARK in x.text for x in blocks]
        for x in blocks:
            x.text = x.text.replace(MARK, "")
        keep = [i for i, x in enumerate(blocks) if x.text]
        out.append(([blocks[i] for i in keep], [labels[i] for i in keep]))
    for page in sampled:
        blocks = leaf_blocks(page)
        if any("in:article" in x.around or "in:main" in x.around for x in blocks):
            out.append((blocks, [("in:article" in x.around or "in:main" in x.around) and not OTHER & {*x.around} for x in blocks]))
    return out


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(x.text for x, content in zip(blocks, field.labels(blocks), strict=True) if content)


def fit(pages: DataFrame, html_col: str = "html", sample: int = 128, made: int = 700) -> Field:
    """A field of `made` generated pages and up to `sample` pages of the table."""
    hashed = F.xxhash64(named(html_col))
    short = pages.where(F.length(named(html_col)) <= SAMPLE_CHARS)
    cut = short.select(hashed.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    found = [] if cut is None else [x[0] for x in short.where(hashed <= cut).select(named(html_col)).limit(sample).collect()]
    return train(labelled_pages(generated(made), sorted(found)))


def _extracted(held, html_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x or "", held.value) for x in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=[*columns, "text", "n_chars"])

    return run


def extract(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(named(id_col).alias("page_id"), named(url_col).alias("url"), named(html_col).alias("html"))
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[:2])
    return rows.mapInArrow(_extracted(pages.sparkSession.sparkContext.broadcast(field), "html", ["page_id", "url"]), f"{schema}, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
