"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open block-level elements.
A block's vector joins the mean of its path features' hashed embeddings, the mean of its words' hashed embeddings and a
few numbers (length, share of link text, punctuation, digits, place in the page). A bidirectional LSTM in numpy reads the
vectors of a page's blocks in order, so every label depends on the whole page; blocks labelled main make the text.

It is trained on the driver from a bounded sample of ``SAMPLE_PAGES`` pages, labelled by their own semantic elements, and
from ``MADE_PAGES`` generated pages in many layouts, whose labels are known.

Defined cases: null is the empty page; scripts, styles, comments, forms' raw text and head titles are never blocks; tags
that don't close, close twice or lack an end are read to the end; drawings are left out up to their end tag, if they have
one; formulas, buttons, choices and the content of objects and canvases are text like any other; character references are decoded after the markup is
read; white space inside a block becomes one space; no block is dropped or cut by length.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import sample_rows, slices

SLOTS, DIM, HIDDEN, NUMBERS = 1 << 13, 12, 16, 6
SAMPLE_PAGES, MADE_PAGES = 300, 500
BATCH_BLOCKS = 4096

# Elements whose content is no markup or no text of the page, elements that don't break blocks, void elements.
RAW = "script|style|textarea|title|noscript|template|iframe"
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
INLINE |= set("math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mspace mstyle mpadded mphantom merror semantics annotation annotation-xml".split())
# Elements that may stand inside a paragraph without ending it.
PHRASING = {"svg", "select", "option", "optgroup", "button", "object", "canvas"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

DRAWING = r"""<svg(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*(?<!/)>.*?</svg\s*>|"""
DRAWING_END = re.compile(r"</svg\s*>", re.I)
# With drawings up to their end, for what lies before the last such end, and without, for what follows it.
MARKUP, AFTER = (re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|{drawing}<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I) for drawing in (DRAWING, ""))
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"\w+").findall
PARTS = re.compile(r"[^\W_]+").findall


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


class _Memo(dict):
    def __missing__(self, key: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[key] = _slot(key)
        return self[key]


_slots = _Memo()


def _markup(page: str) -> Iterator[re.Match]:
    """Markup and text of a page in order; no drawing is looked for where no more ends, so the time is linear."""
    last = max((m.start() for m in DRAWING_END.finditer(page)), default=-1)
    at = 0
    while m := (MARKUP if at < last else AFTER).match(page, at):
        yield m
        at = m.end()


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path features, characters inside links) of every leaf block in page order."""
    out, stack, run, links, in_link = [], [("", ())], [], 0, 0

    def flush() -> None:
        nonlocal run, links
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            path = tuple(f for _, features in stack for f in features)
            pairs = tuple(f"{a[0]}>{b[0]}" for a, b in zip(stack[-3:], stack[-2:], strict=False))
            out.append((text, path + pairs, links))
        run, links = [], 0

    for m in _markup(page or ""):
        name = m[3]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                run.append(piece)
                if in_link:
                    links += len(piece)
            elif m[1] or piece[:4].lower() == "<svg":
                run.append(" ")
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = 0 if m[2] else 1
            elif name == "br":
                run.append(" ")
            continue
        flush()
        in_link = 0
        if m[2]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if at:
                del stack[at:]
            continue
        if (stack[-1][0] == "p" and name not in PHRASING) or stack[-1][0] in CLOSES.get(name, ()):
            stack.pop()
        if name not in VOID and not m[4].endswith("/"):
            features = [f"<{name}"]
            for key, a, b, c in NAMES.findall(m[4]) if m[4] else ():
                features += [f"{key.lower()}:{p}" for p in PARTS((a or b or c).lower())]
            stack.append((name, tuple(features)))
    flush()
    return out


def vectors(pages: list[list[tuple[str, tuple[str, ...], int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat inputs of all blocks: path slots and their first, word slots and their first, numbers."""
    path, path_at, word, word_at, numbers = [], [], [], [], []
    for page in pages:
        for i, (text, features, links) in enumerate(page):
            path_at.append(len(path))
            path += [_slots[f] for f in features] or [_slots[""]]
            word_at.append(len(word))
            found = WORDS(text.lower())
            word += [_slots[w] for w in found] or [_slots[" "]]
            n = len(text)
            marks = text.count(".") + text.count(",") + text.count("?") + text.count("!")
            numbers.append((np.log1p(n) / 5, min(1.0, links / n), min(1.0, 10 * marks / n), min(1.0, len(found) / 50), i / len(page), float(text[-1] in ".!?:;\"'”»")))
    return np.array(path, np.int32), np.array(path_at, np.int64), np.array(word, np.int32), np.array(word_at, np.int64), np.array(numbers, np.float32).reshape(-1, NUMBERS)


def _mean(table: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros((0, table.shape[1]), np.float32)
    counts = np.diff(np.append(first, len(slots)))
    return np.add.reduceat(table[slots], first, axis=0) / counts[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over the blocks of padded pages; two directions in one array."""

    def __init__(self, seed: int = 5):
        r, size = np.random.default_rng(seed), 2 * DIM + NUMBERS
        f = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.path, self.word = (r.normal(0, 0.3, (2, SLOTS, DIM))).astype(np.float32)
        self.wx, self.wh, self.b = f(2, size, 4 * HIDDEN), f(2, HIDDEN, 4 * HIDDEN), np.zeros((2, 1, 4 * HIDDEN), np.float32)
        self.b[:, :, HIDDEN : 2 * HIDDEN] = 1
        self.out, self.out_b = f(2 * HIDDEN + size, 1), np.zeros(1, np.float32)

    @property
    def params(self) -> list[np.ndarray]:
        return [self.path, self.word, self.wx, self.wh, self.b, self.out, self.out_b]

    def inputs(self, flat) -> np.ndarray:
        path, path_at, word, word_at, numbers = flat
        return np.concatenate((_mean(self.path, path, path_at), _mean(self.word, word, word_at), numbers), axis=1)

    @staticmethod
    def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Page, step and step from the end of every block."""
        page = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return page, step, sizes[page] - 1 - step

    def forward(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Logit of every block. Both directions start at their own end, so pages only pad behind."""
        page, step, back = self.places(sizes)
        steps, n = int(sizes.max(initial=0)), len(sizes)
        seq = np.zeros((steps, 2, n, x.shape[1]), np.float32)
        seq[step, 0, page], seq[back, 1, page] = x, x
        pre = np.matmul(seq, self.wx) + self.b
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        hs, tape = np.zeros((steps, 2, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = pre[t] + np.matmul(h, self.wh)
            i, f, o = (_sigmoid(z[:, :, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, :, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                tape.append((i, f, o, g, before, tc, h))
            h = o * tc
            hs[t] = h
        seen = np.concatenate((hs[step, 0, page], hs[back, 1, page], x), axis=1)
        logits = (seen @ self.out)[:, 0] + self.out_b[0]
        return (logits, seen, seq, tape, (page, step, back)) if keep else logits

    def gradients(self, flat, sizes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        x = self.inputs(flat)
        logits, seen, seq, tape, (page, step, back) = self.forward(x, sizes, keep=True)
        d = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)[:, None]
        d_seen = d @ self.out.T
        d_hs = np.zeros((len(tape), 2, len(sizes), HIDDEN), np.float32)
        d_hs[step, 0, page], d_hs[back, 1, page] = d_seen[:, :HIDDEN], d_seen[:, HIDDEN : 2 * HIDDEN]
        d_pre = np.zeros((len(tape), 2, len(sizes), 4 * HIDDEN), np.float32)
        d_wh, d_h, d_c = np.zeros_like(self.wh), 0.0, 0.0
        for t in range(len(tape) - 1, -1, -1):
            i, f, o, g, before, tc, h = tape[t]
            dh = d_hs[t] + d_h
            dc = d_c + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=2)
            d_pre[t] = dz
            d_wh += np.matmul(h.transpose(0, 2, 1), dz)
            d_h, d_c = np.matmul(dz, self.wh.transpose(0, 2, 1)), dc * f
        d_wx = np.einsum("tdnx,tdnz->dxz", seq, d_pre, optimize=True)
        d_in = np.matmul(d_pre, self.wx.transpose(0, 2, 1))
        d_x = d_in[step, 0, page] + d_in[back, 1, page] + d_seen[:, 2 * HIDDEN :]
        grads = []
        for table, (slots, first), part in ((self.path, flat[:2], d_x[:, :DIM]), (self.word, flat[2:4], d_x[:, DIM : 2 * DIM])):
            counts, g = np.diff(np.append(first, len(slots))), np.zeros_like(table)
            np.add.at(g, slots, np.repeat(part / counts[:, None], counts, axis=0))
            grads.append(g)
        return [*grads, d_wx, d_wh, d_pre.sum((0, 2))[:, None], seen.T @ d, d.sum(0)]

    def train(self, pages: list, labels: list[np.ndarray], epochs: int = 5, batch: int = 24, rate: float = 0.01, seed: int = 9) -> None:
        r, moments, t = np.random.default_rng(seed), [(np.zeros_like(p), np.zeros_like(p)) for p in self.params], 0
        own = [i for i, p in enumerate(pages) if p]
        for _ in range(epochs):
            order = r.permutation(own)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                flat = vectors([pages[i] for i in some])
                grads = self.gradients(flat, np.array([len(pages[i]) for i in some]), np.concatenate([labels[i] for i in some]))
                t += 1
                for p, g, (m, v) in zip(self.params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)

    def main(self, pages: list) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length run together."""
        found: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            some, size = [], 0
            while order and (not some or (len(some) + 1) * max(size, len(pages[order[-1]])) <= BATCH_BLOCKS):
                size = max(size, len(pages[order[-1]]))
                some.append(order.pop())
            sizes = np.array([len(pages[i]) for i in some])
            hit = self.forward(self.inputs(vectors([pages[i] for i in some])), sizes) > 0
            for i, part in zip(some, np.split(hit, np.cumsum(sizes)[:-1]), strict=True):
                found[i] = part
        return found

    def text(self, pages: list[str | None]) -> list[str]:
        cut = [blocks(p) for p in pages]
        return [" ".join(b[0] for b, ok in zip(page, hit, strict=True) if ok) for page, hit in zip(cut, self.main(cut), strict=True)]


# Names by which layouts tell their parts apart, for labelling samples and for generated pages.
MAIN_NAMES = "content post entry story article body main text prose".split()
ASIDE_NAMES = "ad ads advert banner sponsor sponsored promo nav navbar menu sidebar widget footer header masthead breadcrumb cookie notice alert consent comment comments respond reply related share social newsletter subscribe form login search pagination tags popup modal".split()


def semantic_labels(page: list[tuple[str, tuple[str, ...], int]]) -> np.ndarray | None:
    """Labels read off a page's own semantic elements; None if it has no main element."""
    out = []
    for _, features, _ in page:
        tags = [f[1:] for f in features if f[0] == "<"]
        names = {f.split(":", 1)[1] for f in features if ":" in f}
        within = "article" in tags or "main" in tags
        out.append(within and not {"nav", "aside", "footer", "form"} & set(tags) and not names & set(ASIDE_NAMES))
    return np.array(out, np.float32) if any(out) else None


def made_page(r: np.random.Generator) -> tuple[str, list[bool]]:
    """A generated page in one of many layouts, and whether each of its text blocks is main text."""
    pick = lambda x: x[int(r.integers(len(x)))]
    word = lambda: "".join(pick("abcdefghilmnoprstuvéñü") for _ in range(int(r.integers(2, 9))))
    words = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: words(int(r.integers(3, 25))).capitalize() + pick(".....?!")
    labels: list[bool] = []

    def block(tag: str, text: str, main: bool) -> str:
        labels.append(main)
        return f"<{tag}>{text}</{tag}>" if r.random() > 0.05 or tag != "p" else f"<{tag}>{text}"

    def links() -> str:
        return "<ul>" + "".join(block("li", f'<a href="/{word()}">{words(int(r.integers(1, 4)))}</a>', False) for _ in range(int(r.integers(1, 8)))) + "</ul>"

    def side() -> str:
        kind = int(r.integers(7))
        tag, name = pick(["div", "div", "section", "aside"]), pick(["", pick(["site-", "main-", "page-", "top-"])]) + pick(ASIDE_NAMES) + pick(["", "", "-box", "-list", "-area"])
        if kind == 0:
            return f"<nav>{links()}</nav>"
        if kind == 1:
            return f"<{pick(['header', 'footer'])}>{block('p', sentence(), False)}{links()}</{pick(['header', 'footer'])}>"
        if kind == 2:
            return f"<aside>{block('h3', words(2), False)}{block('p', sentence(), False)}</aside>"
        if kind == 3:
            return f"<form>{block('p', words(3), False)}<input name=q></form>"
        if kind == 4:
            return f'<{tag} class="{name}">' + "".join(block(pick(["p", "div", "li"]), " ".join(sentence() for _ in range(int(r.integers(1, 4)))), False) for _ in range(int(r.integers(1, 4)))) + f"</{tag}>"
        if kind == 5:
            return f'<{tag} id="{name}">{links()}</{tag}>'
        labels.append(False)
        return f'<{tag} class="{name}">{sentence()}</{tag}>'

    def body() -> str:
        out = block("h1", words(int(r.integers(2, 9))), True) if r.random() < 0.8 else ""
        for _ in range(int(r.integers(1, 12))):
            kind = r.random()
            if kind < 0.75:
                out += block("p", " ".join(sentence() for _ in range(int(r.integers(1, 7)))), True)
            elif kind < 0.85:
                out += block(pick(["h2", "h3", "blockquote", "pre"]), words(int(r.integers(1, 12))), True)
            elif kind < 0.93:
                out += "<ul>" + "".join(block("li", sentence(), True) for _ in range(3)) + "</ul>"
            else:
                out += side() if r.random() < 0.5 else block("p", sentence(), True)
        return out

    before = "".join(side() for _ in range(int(r.integers(0, 4))))
    layout = int(r.integers(5))
    tag = pick(["article", "article", "main", "main"]) if layout < 3 else pick(["div", "section", "td"])
    name = f' class="{pick(["", "post-", "entry-", "article-"])}{pick(MAIN_NAMES)}"' if layout else ""
    inner = body()
    wrap = pick(["", "", "div", "main"]) if layout else ""
    core = f"<{tag}{name}>{inner}</{tag}>"
    core = f"<{wrap}>{core}</{wrap}>" if wrap else core
    after = "".join(side() for _ in range(int(r.integers(0, 4))))
    return f"<html><head><title>{words(4)}</title></head><body>{before}{core}{after}</body></html>", labels


def fit(pages: DataFrame, page_html: str = "html", page_id: str = "page_id", sample_pages: int = SAMPLE_PAGES) -> Labeller:
    own = pages.select(F.col(page_id).alias("i"), F.col(page_html).alias("h")).where("h is not null")
    cut = [blocks(h) for _, h in sorted(map(tuple, sample_rows(own, "i", sample_pages, pages.count())), key=str)]
    samples = [(b, y) for b in cut if b and (y := semantic_labels(b)) is not None]
    r = np.random.default_rng(12)
    while len(samples) < MADE_PAGES + sample_pages:
        page, labels = made_page(r)
        found = blocks(page)
        if len(found) == len(labels):
            samples.append((found, np.array(labels, np.float32)))
    model = Labeller()
    model.train([b for b, _ in samples], [y for _, y in samples])
    return model


def extract(pages: DataFrame, model: Labeller, page_html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, text, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(model.text(batch.column(2).to_pylist()), pa.string())})

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(page_html).alias("html")).mapInArrow(run, "page_id long, url string, text string")


def op3(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
