"""Main text of web pages from flat blocks that a decision tree classifies.

A page is cut to text blocks at block-level tags. A block's features are its word
count and link density, and those of the blocks before and after it; a block at the
page's edge is its own neighbour there. The tree is grown here on labelled_pages(), a
small labelled table of pages in several layouts and languages: it splits by words and links
first, and asks what the tags and names around a block say where these can't tell, as
a long comment is a text like any other. Nothing else decides.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices

BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACED = {"br", "td", "th", "wbr", "img", "option", "input"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't text of the page.
DROPPED = set("script style noscript template head title svg iframe object canvas audio video select textarea button".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template"}
#: Elements that don't nest: a second start means that the first has no end.
FLAT = {"button", "select"}
#: Tags and words of class, id or role names whose blocks are seldom part of an article, and words that are only weak evidence of it.
ASIDE_TAGS = {"nav", "aside", "footer", "form", "header", "dialog", "menu"}
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription "
    "signup sidebar widget widgets related recommended trending share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer masthead toolbar topbar pagination pager comment comments commentlist "
    "disqus reply replies respond login form copyright skip hidden complementary contentinfo notice notices notification notifications".split()
)
WEAK_WORDS = set("alert discussion legal disclaimer tags header search".split())
COMMENT_WORDS = {"comment", "comments", "commentlist", "reply", "replies", "disqus", "respond"}
MAIN_WORDS = {"articlebody", "story", "entry", "post"}
#: An element of the first closes an open one of the second, up to a border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
#: Scripts without blanks between words: a character counts as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[^\W_]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: int
    inside: int  # 1 in an article or main element
    aside: int  # 3 by a tag around it, 2 by a name, 1 by a weak one
    label: int  # 1 where a training page marks it

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class Open:
    tag: str
    inside: int = 0
    aside: int = 0
    link: int = 0
    heading: int = 0
    label: int = 0


def _opened(tag: str, attributes: str, above: Open) -> Open:
    own = Open(tag, above.inside, above.aside, above.link or tag == "a", tag in ("h1", "h2", "h3", "h4", "h5", "h6") or above.heading, above.label)
    names, hidden = [], False
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role", "itemprop"):
                names += [WORDS.findall(x.lower()) for x in value.split()]
            hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower())
            own.label |= name == "data-m"
    said = {w for x in names if x and x[0] not in ("has", "with", "no", "without", "is") for w in x}
    if tag in ("article", "main") and not said & COMMENT_WORDS:
        own.inside, own.aside = 1, 3 if above.aside == 3 else 0
    elif tag not in ("html", "body"):
        if tag in ASIDE_TAGS and not (tag == "header" and above.inside):
            own.aside = 3
        elif hidden or said & ASIDE_WORDS:
            own.aside = max(own.aside, 2)
        elif said & WEAK_WORDS:
            own.aside = max(own.aside, 1)
        if said & MAIN_WORDS and not own.aside:
            own.inside = 1
    return own


def word_count(text: str) -> int:
    return len(text.split()) + (0 if text.isascii() else len(UNSPACED.findall(text)))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in its order; blocks without text are left out."""
    found: list[Block] = []
    stack = [Open("")]
    parts: list[tuple[str, Open]] = []
    where = stack[0]

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(word_count(t) for t, o in parts if o.link)
                found.append(Block(text, word_count(text), linked, max(int(o.heading) for t, o in parts if t.strip()), where.inside, where.aside, where.label))
            parts = []

    def add(raw: str) -> None:
        nonlocal where
        if raw:
            if not raw.isspace():
                where = stack[-1]
            parts.append((html.unescape(raw) if "&" in raw else raw, stack[-1]))

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends = m[1] or m[4]
        if tag in BLOCKS:
            flush()
        elif tag in SPACED:
            parts.append((" ", stack[-1]))
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in DROPPED and not attributes.endswith("/"):
            depth, end = 1, at
            close = re.compile(rf"<(/?){tag}\b[^>]*(?:>|\Z)", re.I)
            while depth:
                e = close.search(page, end)
                if not e or (tag in FLAT and not e[1]):
                    # Without an end, raw text runs to the page's end; other elements drop their start tag alone.
                    end = len(page) if tag in RAW else at
                    break
                end = e.end()
                depth += -1 if e[1] else tag not in RAW
            at = end
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            _close(stack, {"p"}, {"button", "table", "td", "th", "article", "section", "div", "li", "blockquote", "body"})
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        stack.append(_opened(tag, attributes, stack[-1]))
    flush()
    return found


def _close(stack: list[Open], tags: set[str], border: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in border:
            return


FEATURES = "words density words_before density_before words_after density_after heading inside page_inside aside".split()
#: The first of them are of words and links. Splits that are by these alone, the least rows at their sides, and the depth of the tree.
N_TEXT_FEATURES, TEXT_DEPTH, FEW, MOST_DEPTH = 6, 3, 120, 16


def block_features(found: list[Block]) -> list[tuple]:
    article = int(any(b.inside and b.aside < 2 for b in found))
    rows = []
    for i, b in enumerate(found):
        near = [x for o in (found[max(i - 1, 0)], found[min(i + 1, len(found) - 1)]) for x in (o.words, o.density)]
        rows.append((b.words, b.density, *near, int(b.heading), b.inside, article, b.aside))
    return rows


def _best_split(rows: list[tuple], labels: list[int], features: range, least: int):
    """(impurity left, feature, cut) of the best split by one of the features, None if there is none."""
    best = None
    for f in features:
        order = sorted(range(len(rows)), key=lambda i: rows[i][f])
        ones, every = 0, sum(labels)
        for k in range(1, len(order)):
            ones += labels[order[k - 1]]
            low, high = rows[order[k - 1]][f], rows[order[k]][f]
            if low == high or k < least or len(order) - k < least:
                continue
            rest = every - ones
            cost = ones * (1 - ones / k) + rest * (1 - rest / (len(order) - k))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (low + high) / 2)
    return best


def grow(rows: list[tuple], labels: list[int], depth: int = 0):
    """A classification tree by Gini impurity: (feature, cut, at most, above), or the share of label 1 in a leaf.

    The first TEXT_DEPTH splits are by words and links, with sides of a FEW per cent of the table at least. Below them what tags
    and names say is asked first, and words and links again for what these leave open.
    """
    share = sum(labels) / len(labels)
    if depth == MOST_DEPTH or share in (0.0, 1.0):
        return share
    text, said = range(N_TEXT_FEATURES), range(N_TEXT_FEATURES, len(rows[0]))
    tries = [(text, FEW)] if depth < TEXT_DEPTH else []
    for features, least in (*tries, (said, 2), (text, 2)):
        best = _best_split(rows, labels, features, least)
        if best and best[0] < len(labels) * share * (1 - share) - 1e-12:
            break
    else:
        return share
    _, f, cut = best
    sides = [[i for i in range(len(rows)) if (rows[i][f] <= cut) == low] for low in (True, False)]
    return (f, cut, *[grow([rows[i] for i in side], [labels[i] for i in side], depth + 1) for side in sides])


def decide(tree, row: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


#: Texts of the labelled pages in each language: three long sentences, a short one, a heading, a line under the page, a notice, and labels of links.
TEXTS = [
    ("Rain fell on the hills for most of the night and the river rose by a hand before the first light came.", "Nobody in the village could say later who had opened the gate of the mill, though three people had seen it stand wide.", "The keeper wrote down the height of the water every hour and sent a boy with the numbers to the town.", "By noon it had gone.", "The river", "Copyright 2001 The Valley Paper", "We use cookies to make the site better for you and for all our partners.", "Home World Sport Contact Prices About-us".split()),
    ("Der Regen fiel die ganze Nacht auf die Hügel und der Fluss stieg um eine Handbreit, bevor es hell wurde.", "Niemand im Dorf konnte später sagen, wer das Tor der Mühle geöffnet hatte, obwohl drei Leute es offen gesehen hatten.", "Der Wärter schrieb jede Stunde den Stand des Wassers auf und schickte einen Jungen mit den Zahlen in die Stadt.", "Mittags war es fort.", "Hochwasser im Tal", "Alle Rechte vorbehalten, Talzeitung", "Wir verwenden Kekse, damit die Seite für Sie und unsere Partner besser wird.", "Start Welt Sport Kontakt Preise Impressum".split()),
    ("La lluvia cayó sobre las colinas casi toda la noche y el río subió un palmo antes de la primera luz.", "Nadie en el pueblo supo decir después quién había abierto la puerta del molino, aunque tres la habían visto abierta.", "El guarda apuntaba cada hora la altura del agua y mandaba a un chico con los números a la ciudad.", "Se fue al mediodía.", "El molino abierto", "Todos los derechos reservados", "Usamos galletas para que el sitio sea mejor para usted y para nuestros socios.", "Inicio Mundo Deportes Contacto Precios Aviso".split()),
    ("夜里大部分时间山上都在下雨天亮之前河水涨了一掌高。", "后来村里没有人能说出是谁打开了磨坊的门虽然有三个人看见门是开着的。", "看守每小时记下水位并派一个孩子把数字送到城里。", "中午水退了。", "河水", "版权所有 山谷报", "我们使用饼干让网站对您和我们的伙伴更好。", "首页 世界 体育 联系 价格 关于".split()),
]


#: Words of blocks on some of the labelled pages, and how many such pages of each layout there are for a language.
LENGTHS, PAGES = (1, 2, 3, 5, 8, 12, 18, 25, 35, 50, 80, 130, 220, 400), 12


def labelled_pages() -> list[str]:
    """The labelled table: pages whose article blocks are in elements with data-m."""
    pages = []
    for a, b, c, short, head, line, notice, labels in TEXTS:
        links = [f"<a href=/{i}>{x}</a>" for i, x in enumerate(labels)]
        menu, row, two = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " ".join(links), f"<a href=/n>{labels[0]} {labels[1]}</a>"
        long = f"<p>{a} {b} {c} {b} {a}</p>"
        pages += [f"<p data-m>{short}</p>", f"<div><p data-m>{head}</p><p data-m>{short}</p></div>", f"<p data-m>{short}</p><p data-m>{short} {short}</p><p data-m>{head}</p>"]
        pages += [f"<{x}>{long}<p>{short}</p>{long}</{x.split()[0]}><div data-m>{long}</div><{x}>{long}</{x.split()[0]}>" for x in ("div class=comments", "aside", "div class=sidebar", "footer", "form", "div class=cookie", "nav", "div class=related")]
        pages += [f"<{x}>{long}<p>{short}</p></{x.split()[0]}><article data-m>{long}<p>{short}</p></article><{x}>{short}{long}</{x.split()[0]}>" for x in ("div class=comments", "aside", "div", "footer", "div class=cookie")]
        # In an article, and in a box beside it, blocks may have any lengths in any order.
        cut = lambda k, t=f"{a} {b} {c}": f"<p>{' '.join(t.split()[:k]) if t.isascii() or ' ' in t[:9] else t[:k]}</p>"
        for order in ((1, 2, 30, 3, 3, 1, 12, 2, 5, 2, 4, 1, 40, 3, 2, 14, 1, 1, 6), (3, 1, 1, 25, 2, 4, 1, 9, 2, 2, 2, 18, 3, 35, 1, 5, 1, 16, 4)):
            mixed = "".join(cut(k) for k in order)
            pages += [
                f"<nav>{menu}</nav><div class=ad>{cut(order[4])}</div><article data-m><h1>{head}</h1>{mixed}</article><div class=promo>{mixed}</div><div>{mixed}</div><footer>{line}</footer>",
                f"<div>{mixed}</div><main><div data-m>{mixed}</div><p class=notice>{short}</p><div data-m>{mixed}</div></main><aside>{mixed}</aside><div class=legal>{mixed}</div><form>{mixed}</form>",
                f"<div class=comments>{mixed}</div><p>{row}</p><div class=cookie>{mixed}</div><div>{row}</div>",
            ]
        # Blocks of any lengths in the article and in boxes beside it, with names that say nothing.
        rng = random.Random(len(a))
        say = lambda k: cut(k, " ".join([a, b, c] * (1 + k // 20)) if " " in a else (a + b + c) * (1 + k // 40))
        some = lambda n: "".join(say(rng.choice(LENGTHS)) for _ in range(n))
        for _ in range(PAGES):
            name, few, n = rng.choice(("x1", "content", "col-b", "k9 z")), say(rng.randint(2, 12)), rng.randint(2, 9)
            body, bottom = some(n), rng.choice((line, f"{line} {short}", f"{line} {a}"))
            marked = body.replace("<p>", "<p data-m>")
            pages += [
                f"<nav>{menu}</nav><div class=ad>{few}</div><article data-m><h1>{head}</h1>{body}</article><footer>{bottom}</footer>",
                f"<nav>{menu}</nav><div class='{name}'>{say(rng.randint(2, 9))}</div><article data-m><h1>{' '.join(c.split()[: rng.randint(3, 14)]) or head}</h1>{body}</article><footer>{bottom}</footer>",
                f"<header>{rng.choice((line, menu, row))}</header><main data-m><h1>{head}</h1>{body}</main><aside>{some(3)}</aside><div class=comments>{some(4)}</div><footer>{bottom}</footer>",
                f"<header>{rng.choice((line, menu, row))}</header><div class='{name}'><h2 data-m>{head}</h2>{marked}<p data-m>{short}</p></div><div class=comments>{some(3)}</div><footer>{bottom}</footer>",
                f"{menu}<div class='{name}'><h1 data-m>{head}</h1>{marked}</div>{menu}<p>{row}</p>",
                f"<div class=sidebar>{some(3)}</div><div class='{name}'>{marked}</div><div class=related>{menu}{some(2)}</div><form>{some(2)}</form>",
            ]
        for body in (f"<p>{a}</p><p>{b}</p><p>{short}</p><p>{c} {a}</p>", f"<p>{short}</p><p>{c}</p>", f"<p>{a} {b} {c}</p>"):
            marked = body.replace("<p>", "<p data-m>")
            pages += [
                # By the tags of HTML 5.
                f"<nav>{menu}</nav><div class=ad>{short} {short}</div><article data-m><h1>{head}</h1>{body}</article><footer>{line}</footer>",
                f"<header><h1>{line}</h1>{menu}</header><main data-m><h2>{head}</h2>{body}<ul><li>{short}</li><li>{two}</li></ul></main><aside><h3>{head}</h3><p>{b}</p></aside><footer><p>{short} {line}</p></footer>",
                f"<div class=cookie-notice><p>{notice}</p></div><article data-m><header><h1>{head}</h1></header>{body}<blockquote>{short}</blockquote></article><section class=related>{menu}</section>",
                f"<form><label>{labels[0]}</label><p>{notice}</p></form><article data-m>{body}<table><tr><td>{head}</td><td>{labels[2]}</td></tr></table></article><div id=sidebar><p>{b}</p></div>",
                f"<article><div data-m><h1>{head}</h1>{body}</div><aside><p>{a}</p></aside><p data-m>{b}</p><div class=newsletter><p>{notice}</p></div><footer><p>{line}</p></footer></article>",
                f"<nav><p>{a}</p></nav><div class=advert>{b}</div><article data-m><h1>{head}</h1><p>{short}</p>{body}</article><section id=comments><article class=comment><p>{c}</p></article><article class=comment><p>{short}</p></article></section>",
                f"<article><div data-m><p class=legal>{short}</p>{body}</div><p class=notice>{b}</p><div id=discussion data-m><p>{short}</p>{c}</div></article><div class=legal>{line}</div>",
                f"<nav>{menu}</nav><article data-m><h1>{two}</h1>{body}<p>{two}</p><ul><li>{links[3]}</li></ul></article><div class=notice>{notice}</div>",
                # By names.
                f"<div id=menu>{row}</div><div id=story><h1 data-m>{head}</h1>{marked}<div class=share>{two}</div></div><div class=comments><p>{short}</p><p>{a}</p></div><div class=copyright>{line}</div>",
                f"<div class=navbar>{row}</div><div class=page>{marked}</div><div class=sidebar><p>{b}</p><p>{short}</p></div><div class=footer>{line}</div>",
                # Without either: word counts and links of blocks and their neighbours alone tell.
                f"<div>{row}</div><h1 data-m>{head}</h1>{marked}<div>{two} {links[4]}</div>",
                f"{menu}<div>{marked}</div>{menu}<div>{line}</div>",
                f"<table><tr><td>{menu}</td><td><h2 data-m>{head}</h2>{marked}</td></tr></table><p>{row}</p>",
                f"<p>{row}</p>{marked}<h3 data-m>{head}</h3><p data-m>{c} {b} {two}</p><p>{two}</p><p>{row}</p>",
                f"<div>{labels[0]}</div>{marked}<div>{labels[5]}</div><div>{row}</div>",
                f"<div>{marked}</div>",
                f"{marked}<p data-m>{head.split()[0]}</p>",
                f"<h1 data-m>{head}</h1>{marked}",
                f"<div>{menu}</div><p>{row}</p><div>{two}</div>",
            ]
    return pages


def trained():
    rows, labels = [], []
    for page in labelled_pages():
        found = blocks(page)
        rows += block_features(found)
        labels += [b.label for b in found]
    return grow(rows, labels)


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, block_features(found), strict=True) if decide(tree, row) > 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages, from its whole html.

    A null or empty html, or one of links alone, gives an empty text. Broken
    markup is read as far as it goes. Repeated rows and null ids give a row each;
    other columns are left out.
    """
    tree = trained()

    def run(batches):
        for batch in in_slices(batches, "html"):
            texts = [main_text(p or "", tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
