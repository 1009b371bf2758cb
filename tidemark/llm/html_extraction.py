"""Main-text extraction by a recurrent block labeller.

A page is cut into blocks: the text between block-level tags, each with the path of tags above
it. Every block becomes a vector of hashed tag-path names and hashed words plus a few plain measures, and a
bidirectional LSTM in numpy reads the page's blocks in order, so each is classified with the
whole document around it. The network is fitted on a bounded sample of the pages by distant supervision:
structural names that HTML gives a meaning (nav, footer, aside, form, "advert", "comments" ...) label
the blocks, and they are hidden from the input in part of the examples, so that position, length,
links and neighbours are learned as well.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import hashed_sample, ship

# Elements by what HTML says of them.
INVISIBLE = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea option datalist".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_KIND = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# Words that name boilerplate as an element, class, id or role.
BOILERPLATE = frozenset((
    "nav navbar navigation menu header masthead banner footer aside sidebar side ad ads advert advertisement adverts sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login form search comment comments respond reply disqus "
    "related recommended share sharing social breadcrumb breadcrumbs pagination pager toolbar widget copyright legal rail skip button dialog").split())
CONTENT = frozenset("article main content post entry story body text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORDS = re.compile(r"\w+")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

DIMENSIONS = 512
MEASURES = 8
# Bounds the feature rows of a task. A longer page runs alone; it holds only the 16 hidden values and 64 gate inputs of each block and side.
BLOCKS_AT_ONCE = 8_192


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # names of the elements above, outermost first
    names: frozenset[str]  # words of their tags, classes, ids and roles
    linked: float  # share of its characters inside links


def _attributes(source: str) -> dict[str, str]:
    """Names in lower case and values; of repeated names the first counts, as in HTML."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), a or b or c)
    return found


def _name_words(tag: str, attributes: dict[str, str]) -> frozenset[str]:
    words = {tag}
    for value in filter(None, map(attributes.get, ("class", "id", "role"))):
        spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)
        words.update(w for w in _SPLIT.split(spaced.lower()) if w)
    return frozenset(words)


def _is_hidden(attributes: dict[str, str]) -> bool:
    return ("hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true"
            or bool(_NO_DISPLAY.search(html.unescape(attributes.get("style", "")))))


def blocks_of(page: str) -> list[Block]:
    """Visible blocks of a page in order. Unclosed and misnested tags are closed where HTML would close them."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str], bool]] = []  # tag, name words, hidden
    parts: list[str] = []
    state = {"linked": 0, "all": 0}

    def flush():
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append(Block(text, tuple(t for t, *_ in stack if t not in INLINE), frozenset().union(*(n for _, n, _ in stack)) if stack else frozenset(),
                               state["linked"] / max(1, state["all"])))
        parts.clear()
        state["linked"] = state["all"] = 0

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text and not any(h for *_, h in stack):
            parts.append(text)
            n = len(text.strip())
            state["all"] += n
            state["linked"] += n if any(t == "a" for t, *_ in stack) else 0
        if not m:
            break
        at = m.end()
        closing, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            close(tag)
            continue
        if tag in VOID:
            continue
        if tag not in IN_HEAD and any(t == "head" for t, *_ in stack):
            close("head")
        if tag in CLOSES_P and any(t == "p" for t, *_ in stack):
            close("p")
        for same in SAME_KIND.get(tag, "").split():
            inside = [t for t, *_ in stack]
            if same in inside and not {"ul", "ol", "dl", "table"} & set(inside[len(inside) - inside[::-1].index(same):]):
                close(same)
        attributes = m.group(3) or ""
        if attributes.endswith("/"):
            continue
        named = _attributes(attributes)
        stack.append((tag, _name_words(tag, named), tag in INVISIBLE or _is_hidden(named)))
        if tag in RAW_TEXT:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = stop.start() if stop else end
    flush()
    return found


def is_boilerplate(block: Block) -> bool:
    """What the structural names of a block say; this labels the examples and is never asked at extraction."""
    return bool(block.names & BOILERPLATE)


@lru_cache(maxsize=1 << 16)
def _slot(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) % DIMENSIONS


def features(blocks: list[Block], hide: bool = False, first: int = 0, total: int | None = None) -> np.ndarray:
    """A row per block: hashed tag path, names and words, and plain measures. ``hide`` leaves out the telling names.

    Every name of the path and every word of the text counts, scaled by the square root of how many there are. The blocks
    may be part of a page of ``total`` blocks, from block ``first``.
    """
    x = np.zeros((len(blocks), DIMENSIONS + MEASURES), np.float32)
    total = total or len(blocks)
    for i, b in enumerate(blocks):
        path = [t for t in b.path if not hide or t not in BOILERPLATE | CONTENT]
        for t in path:
            x[i, _slot("path", t)] += 2 / math.sqrt(len(path))
        for n in b.names:
            if not hide or n not in BOILERPLATE | CONTENT:
                x[i, _slot("name", n)] += 1
        words = [_slot("word", w) for w in _WORDS.findall(b.text.lower())]
        if words:
            x[i, :DIMENSIONS] += np.bincount(words, minlength=DIMENSIONS) / (4 * math.sqrt(len(words)))
        marks = sum(b.text.count(c) for c in ".,;:!?")
        x[i, DIMENSIONS:] = (math.log1p(len(b.text)) / 6, b.linked, min(1, marks / 8), (first + i) / max(1, total - 1), min(1, len(b.path) / 8),
                             any(t in ("h1", "h2", "h3", "h4") for t in b.path[-1:]), "p" in b.path, "li" in b.path)
    return x


class BlockLabeller:
    """Bidirectional LSTM over the blocks of a page with a logistic output for each."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng, d = np.random.default_rng(seed), DIMENSIONS + MEASURES
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p[f"W{side}"] = (rng.standard_normal((d, 4 * hidden)) * 0.1).astype(np.float32)
            self.p[f"U{side}"] = (rng.standard_normal((hidden, 4 * hidden)) / math.sqrt(hidden)).astype(np.float32)
            self.p[f"c{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["V"] = (rng.standard_normal((2 * hidden, 1)) * 0.1).astype(np.float32)
        self.p["b"] = np.zeros(1, np.float32)

    def _run(self, drive: np.ndarray, side: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """Hidden states of (pages, blocks, gate inputs), and what the backward pass needs."""
        n, steps, _ = drive.shape
        h = c = np.zeros((n, self.hidden), np.float32)
        out, kept = np.empty((n, steps, self.hidden), np.float32), []
        k = self.hidden
        for t in range(steps):
            z = drive[:, t] + h @ self.p[f"U{side}"]
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k:2 * k]), _sigmoid(z[:, 2 * k:3 * k]), np.tanh(z[:, 3 * k:])
            before, c_before = h, c
            c = f * c + i * g
            h = o * np.tanh(c)
            if keep:
                kept.append((before, c_before, i, f, o, g, c))
            out[:, t] = h
        return out, kept

    def _back(self, x, side, kept, dh_out, grads) -> None:
        n, steps, _ = x.shape
        dh = dc = np.zeros((n, self.hidden), np.float32)
        dz_all = np.empty((n, steps, 4 * self.hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            before, c_before, i, f, o, g, c = kept[t]
            dh = dh + dh_out[:, t]
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grads[f"U{side}"] += before.T @ dz
            dz_all[:, t] = dz
            dh, dc = dz @ self.p[f"U{side}"].T, dc * f
        grads[f"W{side}"] += np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        grads[f"c{side}"] += dz_all.sum(axis=(0, 1))

    def _logits(self, x: np.ndarray, lengths: np.ndarray):
        back = _reverse(x, lengths)
        hf, kf = self._run(self._drive(x, "f"), "f")
        hb, kb = self._run(self._drive(back, "b"), "b")
        h = np.concatenate([hf, _reverse(hb, lengths)], axis=2)
        return (h @ self.p["V"])[..., 0] + self.p["b"], (back, kf, kb, h)

    def _drive(self, x: np.ndarray, side: str) -> np.ndarray:
        return x @ self.p[f"W{side}"] + self.p[f"c{side}"]

    def _drives(self, page: list[Block]) -> tuple[np.ndarray, np.ndarray]:
        """Gate inputs of a page for both sides; feature rows exist for ``BLOCKS_AT_ONCE`` blocks at a time."""
        forth, back = (np.empty((len(page), 4 * self.hidden), np.float32) for _ in range(2))
        for a in range(0, len(page), BLOCKS_AT_ONCE):
            x = features(page[a:a + BLOCKS_AT_ONCE], first=a, total=len(page))
            forth[a:a + len(x)], back[a:a + len(x)] = self._drive(x, "f"), self._drive(x, "b")
        return forth, back

    def fit(self, pages: list[list[Block]], steps: int = 240, batch: int = 24, rate: float = 0.01, seed: int = 5) -> BlockLabeller:
        """Adam on binary cross-entropy; a quarter of the examples hide the names that gave the labels."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        known: dict[tuple[int, bool], np.ndarray] = {}

        def seen(i: int, hide: bool) -> np.ndarray:
            if (i, hide) not in known:
                known[i, hide] = features(pages[i], hide)
            return known[i, hide]

        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(pages), batch).tolist()
            x, lengths = _padded([seen(i, bool(rng.random() < 0.25)) for i in chosen])
            y, _ = _padded([np.array([[float(not is_boilerplate(b))] for b in pages[i]], np.float32) for i in chosen])
            mask = np.arange(x.shape[1]) < lengths[:, None]
            logits, (back, kf, kb, h) = self._logits(x, lengths)
            d = ((_sigmoid(logits) - y[..., 0]) * mask / mask.sum()).astype(np.float32)
            grads = {k: np.zeros_like(v) for k, v in self.p.items()}
            grads["V"] = np.tensordot(h, d, ((0, 1), (0, 1)))[:, None]
            grads["b"] = d.sum(keepdims=True)[0]
            dh = d[..., None] * self.p["V"][:, 0]
            self._back(x, "f", kf, dh[..., : self.hidden], grads)
            self._back(back, "b", kb, _reverse(np.ascontiguousarray(dh[..., self.hidden:]), lengths), grads)
            for k in self.p:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probability of each block to be main text. Pages of like length run together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            n = max(1, BLOCKS_AT_ONCE // len(pages[order[-1]]))
            part, order = order[-n:], order[:-n]
            forth, back = zip(*(self._drives(pages[i]) for i in part))
            (forth, lengths), (back, _) = _padded(list(forth)), _padded(list(back))
            h = np.concatenate([self._run(forth, "f", keep=False)[0], _reverse(self._run(_reverse(back, lengths), "b", keep=False)[0], lengths)], axis=2)
            logits = (h @ self.p["V"])[..., 0] + self.p["b"]
            for row, i in enumerate(part):
                out[i] = _sigmoid(logits[row, : lengths[row]])
        return out


def _sigmoid(a):
    return 1 / (1 + np.exp(-np.clip(a, -30, 30)))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), int(lengths.max()), rows[0].shape[1]), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, lengths


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse, padding left at the end."""
    at = np.arange(x.shape[1])
    index = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, index[..., None], axis=1)


def fit_labeller(pages: DataFrame, sample_pages: int = 300, sample_blocks: int = 120) -> BlockLabeller | None:
    """Fit on ``sample_pages`` pages by hash, ``sample_blocks`` blocks of each; the bounds hold only for fitting."""
    part = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sample = hashed_sample(part.filter(F.length("html") > 0), ["url", "html"], sample_pages, pages.count())
    chosen = [b[:sample_blocks] for r in sample.collect() if (b := blocks_of(r["html"]))]
    return BlockLabeller().fit(chosen + _invented_pages()) if chosen else None


def _invented_pages() -> list[list[Block]]:
    """Layouts that a site sample may lack: every boilerplate name around short, linked and long text, beside an article."""
    rng, pages = np.random.default_rng(11), []
    names = sorted(BOILERPLATE)
    say = lambda n: " ".join(f"w{int(k)}" for k in rng.integers(0, 500, n)).capitalize() + "."

    def junk(name):
        n, tag = int(rng.integers(1, 40)), name if name in ("nav", "header", "footer", "aside", "form") else ("div", "section", "ul")[int(rng.integers(3))]
        inner = [f"<p>{say(n)}</p>", f"<ul><li><a href='/'>{say(2)}</a></li><li><a href='/'>{say(3)}</a></li></ul>", say(n), f"<div><p>{say(n)}</p></div>"][int(rng.integers(4))]
        attribute = ("class", "id", "role")[int(rng.integers(3))]
        return f"<{tag} {attribute}='{('', 'site-', 'page ')[int(rng.integers(3))]}{name}'>{inner}</{tag}>"

    for i in range(160):
        body = "".join(f"<{t}>{say(int(rng.integers(3, 80)))}</{t}>" for t in rng.choice(["p", "p", "p", "h2", "blockquote", "li", "pre", "td"], int(rng.integers(2, 9))))
        around = ("article", "main", "div class='content'", "div id='post-body'", "section", "div")[i % 6]
        inside = junk(names[int(rng.integers(len(names)))]) if i % 3 == 0 else ""
        before = "".join(junk(names[(i * 5 + k) % len(names)]) for k in range(int(rng.integers(1, 4))))
        after = "".join(junk(names[(i * 7 + k) % len(names)]) for k in range(int(rng.integers(1, 4))))
        pages.append(blocks_of(f"<body>{before}<{around}><h1>{say(6)}</h1>{body}{inside}</{around.split()[0]}>{after}</body>"))
    return pages


def extract(page: str | None, probabilities: np.ndarray | None = None, labeller: BlockLabeller | None = None) -> str:
    """Main text of one page: its chosen blocks in order, joined by an empty line."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    p = labeller.label([blocks])[0] if probabilities is None else probabilities
    return "\n\n".join(b.text for b, x in zip(blocks, p) if x >= 0.5)


def extract_pages(pages: DataFrame, labeller: BlockLabeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The whole html is read; null and pages without visible text give an empty text. Repeated rows give
    repeated results; other columns are not read.
    """
    ship(pages.sparkSession)
    labeller = labeller or fit_labeller(pages)

    def run(batches):
        for batch in batches:
            sources = [x or "" for x in batch.column(2).to_pylist()]
            for a in range(0, len(sources), 128):
                cut = [blocks_of(s) for s in sources[a:a + 128]]
                kept = labeller.label(cut) if labeller else [np.empty(0)] * len(cut)
                texts = ["\n\n".join(b.text for b, x in zip(bs, p) if x >= 0.5) for bs, p in zip(cut, kept)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:a + 128], batch.column(1)[a:a + 128], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
