"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, each with the path of elements around it.  A bidirectional
LSTM in numpy reads the blocks in page order, each as the mean vector of its hashed path
parts, the mean vector of its hashed words and a few counts, and labels every block with
the whole page in view; the blocks labelled main, joined, are the text.

It is trained on a bounded sample of pages.  Blocks whose path says what they are (an
article's paragraph; a menu, a footer, an advert) are the labelled ones; to know kinds that
a sample lacks, training pages are varied: their main path is rewritten and blocks under
other names for boilerplate are put between theirs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tesserae.llm.codes import prefix_sums, span_hash, words
from tesserae.llm.frames import free_name, pieces

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements inside a line of text; all others bound blocks.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var img wbr".split())
#: Path parts that mark boilerplate, and those that mark the main text, where labelled blocks are taken from.
OTHER = set("nav header footer aside form button select option dialog menu ad ads advert advertisement banner sponsor promo cookie consent notice alert popup modal sidebar widget comment comments "
            "reply replies related recommended share social breadcrumb breadcrumbs pagination navbar navigation newsletter subscribe login search toolbar copyright".split())
MAIN = {"article", "main"}
_OTHER_PATHS = ["nav ul li", "header", "header div", "footer", "footer p", "aside", "aside p", "div sidebar p", "div ad", "div advert", "section ads", "div cookie notice p", "div notice", "div alert", "div banner", "form", "form label", "form p",
                "div comments p", "section comments div comment p", "div comment", "ul comments li", "div related ul li", "div share", "div social", "div newsletter form", "div promo p", "div popup", "div breadcrumbs", "div pagination", "div widget", "div login form"]
_MAIN_PATHS = ["article", "main", "main article", "div content article", "main div content", "article section", "article div body"]
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, HIDDEN, COUNTS = 1 << 12, 1 << 13, 16, 8, 16, 5
BATCH_CHARS = 1_000_000


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """Leaf blocks in page order: path parts, text, share of its characters in links."""
    page = _CUT_OFF.sub("", page or "")
    out, path, text = [], [], []
    linked = link = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((tuple(part for _, parts in path for part in parts), whole, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    while found := _TAG.search(page, at):
        if found.start() > at:
            text.append(page[at:found.start()])
            linked += link and found.start() - at
        at = found.end()
        close, name, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name == "a":
            link = 0 if close else 1
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            continue
        if name in RAW:
            flush()
            if not close and not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        flush()
        if close:
            if any(own == name for own, _ in path):
                while path.pop()[0] != name:
                    pass
            continue
        if name in VOID:
            continue
        while path and (path[-1][0] == "p" or path[-1][0] == name and name in ("li", "tr", "td", "th", "dt", "dd", "option")):
            path.pop()
        names = [n for m in _NAMES.finditer(rest) for n in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()) if n] if rest else []
        path.append((name, (name, *names)))
    if at < len(page):
        text.append(page[at:])
        linked += link and len(page) - at
    flush()
    return out


def gold(path: tuple[str, ...]) -> int:
    """1 main, 0 boilerplate, -1 the path does not say."""
    inside = next((k for k, part in enumerate(path) if part in MAIN), None)
    if inside is None:
        return 0 if OTHER & set(path) else -1
    after = set(path[inside:])
    return -1 if after & {"header", "footer"} else 0 if after & OTHER else 1


@dataclass
class Model:
    path: np.ndarray     # vectors of path parts
    word: np.ndarray     # vectors of words
    gates: list[np.ndarray]   # of each direction: (inputs + HIDDEN + 1, 4 * HIDDEN)
    out: np.ndarray      # (2 * HIDDEN + 1,)


def _inputs(pages: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all blocks of all pages: path buckets and their first, word buckets and their first, counts, each page's first block."""
    every = [b for page in pages for b in page]
    first = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    parts = [[xxhash.xxh32_intdigest(x) % PATH_BUCKETS for x in (*path, "/" + "/".join(path[-2:]), "root")] for path, _, _ in every]
    path_first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    w = words([text for _, text, _ in every])
    hashed = (span_hash(prefix_sums(w.codes), w.starts, w.ends) >> np.uint64(51)).astype(np.int64) if len(w.starts) else np.zeros(0, np.int64)
    size = np.array([len(text) for _, text, _ in every], dtype=float)
    place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages]) if every else np.zeros(0)
    n = np.diff(w.first)
    counts = np.stack([np.log1p(size) / 5, np.log1p(n) / 4, np.array([share for _, _, share in every]), place, np.array([t[-1:] in ".!?" for _, t, _ in every], dtype=float)], axis=1) if every else np.zeros((0, COUNTS))
    return np.array([x for p in parts for x in p], dtype=np.int64), path_first, hashed, w.first, counts, first


def _mean(table: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(first), table.shape[1]))
    np.cumsum(np.add.reduceat(table[buckets], first[:-1][np.diff(first) > 0], axis=0), axis=0, out=sums[1:np.count_nonzero(np.diff(first)) + 1]) if len(buckets) else None
    full = np.concatenate([[0], np.cumsum(np.diff(first) > 0)])
    return (sums[full[1:]] - sums[full[:-1]]) / np.maximum(np.diff(first), 1)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _steps(first: np.ndarray, backward: bool) -> list[np.ndarray]:
    """Block indices of each step, longest pages first, so that pages under way are a prefix."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    begin, length = first[:-1][order], length[order]
    reach = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), side="right")
    return [(begin[:n] + length[:n] - 1 - t) if backward else begin[:n] + t for t, n in enumerate(reach)]


def _run(x: np.ndarray, steps: list[np.ndarray], weights: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of one direction, and what its gradient needs."""
    inputs = x @ weights[:x.shape[1]] + weights[-1]
    inner = weights[x.shape[1]:-1]
    hidden, trace = np.zeros((len(x), HIDDEN)), []
    h = c = np.zeros((len(steps[0]) if steps else 0, HIDDEN))
    for at in steps:
        h, c = h[:len(at)], c[:len(at)]
        z = inputs[at] + h @ inner
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep:
            trace.append((at, h, c, i, f, o, g, tanh))
        h, c = o * tanh, new
        hidden[at] = h
    return hidden, trace


def _back(x: np.ndarray, grad: np.ndarray, trace: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the weights and of the inputs of one direction."""
    inner = weights[x.shape[1]:-1]
    dz_all = np.zeros((len(x), 4 * HIDDEN))
    d_inner = np.zeros_like(inner)
    dh = dc = np.zeros((0, HIDDEN))
    for at, h, c, i, f, o, g, tanh in reversed(trace):
        more = len(at) - len(dh)
        dh = np.concatenate([dh, np.zeros((more, HIDDEN))]) + grad[at]
        dc = np.concatenate([dc, np.zeros((more, HIDDEN))]) + dh * o * (1 - tanh ** 2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
        dz_all[at] = dz
        d_inner += h.T @ dz
        dh, dc = dz @ inner.T, dc * f
    return np.concatenate([x.T @ dz_all, d_inner, dz_all.sum(0)[None]]), dz_all @ weights[:x.shape[1]].T


def predict(pages: list[list[tuple]], model: Model) -> list[np.ndarray]:
    """Probability of being main text of every block of every page."""
    parts, path_first, hashed, word_first, counts, first = _inputs(pages)
    x = np.concatenate([_mean(model.path, parts, path_first), _mean(model.word, hashed, word_first), counts], axis=1)
    both = [_run(x, _steps(first, k == 1), model.gates[k], False)[0] for k in range(2)]
    prob = _sigmoid(np.concatenate([*both, np.ones((len(x), 1))], axis=1) @ model.out)
    return [prob[a:b] for a, b in zip(first, first[1:])]


def _varied(page: list[tuple], rng: np.random.Generator, spare: list[str]) -> list[tuple]:
    """A page under other names: its main path rewritten, blocks of other boilerplate put in."""
    main = tuple(_MAIN_PATHS[rng.integers(len(_MAIN_PATHS))].split())
    other = rng.random() < 0.5
    out = []
    for path, text, share in page:
        kind = gold(path)
        if kind == 1 and other:
            path = ("html", "body", *main, *path[next(k for k, p in enumerate(path) if p in MAIN) + 1:])
        elif kind == 0 and rng.random() < 0.5:
            path = ("html", "body", *_OTHER_PATHS[rng.integers(len(_OTHER_PATHS))].split())
        out.append((path, text, share, kind))
        if rng.random() < 0.2:
            inside = main if kind == 1 and rng.random() < 0.5 else ()
            out.append((("html", "body", *inside, *_OTHER_PATHS[rng.integers(len(_OTHER_PATHS))].split()), spare[rng.integers(len(spare))], float(rng.random() < 0.3), 0))
    return out


def train(pages: list[str], epochs: int = 8, rate: float = 0.02) -> Model:
    """Fit the labeller on pages by Adam; without a labelled block every block counts as main."""
    rng = np.random.default_rng(9)
    size = PATH_DIM + WORD_DIM + COUNTS
    model = Model(
        rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)),
        [rng.normal(0, 0.2, (size + HIDDEN + 1, 4 * HIDDEN)) for _ in range(2)], np.zeros(2 * HIDDEN + 1),
    )
    cut_up = [b for b in map(blocks, pages) if b]
    if not any(gold(path) >= 0 for page in cut_up for path, _, _ in page):
        model.out[-1] = 5.0
        return model
    spare = [text for page in cut_up for path, text, _ in page if len(text) < 400] or ["more"]
    weights = [model.path, model.word, *model.gates, model.out]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(cut_up))
        for k in range(0, len(order), 16):
            batch = [_varied(cut_up[p], rng, spare) for p in order[k:k + 16]]
            y = np.array([kind for page in batch for *_, kind in page], dtype=float)
            parts, path_first, hashed, word_first, counts, first = _inputs([[b[:3] for b in page] for page in batch])
            x = np.concatenate([_mean(model.path, parts, path_first), _mean(model.word, hashed, word_first), counts], axis=1)
            runs = [_run(x, _steps(first, d == 1), model.gates[d], True) for d in range(2)]
            top = np.concatenate([runs[0][0], runs[1][0], np.ones((len(x), 1))], axis=1)
            delta = np.where(y >= 0, _sigmoid(top @ model.out) - y, 0.0) / max(1, (y >= 0).sum())
            down = delta[:, None] * model.out[:-1]
            sides = [_back(x, down[:, d * HIDDEN:(d + 1) * HIDDEN], runs[d][1], model.gates[d]) for d in range(2)]
            dx = sides[0][1] + sides[1][1]
            d_path, d_word = np.zeros_like(model.path), np.zeros_like(model.word)
            np.add.at(d_path, parts, np.repeat(dx[:, :PATH_DIM] / np.maximum(np.diff(path_first), 1)[:, None], np.diff(path_first), axis=0))
            np.add.at(d_word, hashed, np.repeat(dx[:, PATH_DIM:PATH_DIM + WORD_DIM] / np.maximum(np.diff(word_first), 1)[:, None], np.diff(word_first), axis=0))
            step += 1
            for w, m, s, g in zip(weights, mean, square, (d_path, d_word, sides[0][0], sides[1][0], top.T @ delta)):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return model


def extract(pages: list[str | None], model: Model) -> list[str]:
    """Main text of each page."""
    out = []
    for part in pieces([len(p or "") for p in pages], BATCH_CHARS):
        cut_up = [blocks(p) for p in pages[part]]
        for page, prob in zip(cut_up, predict(cut_up, model)):
            out.append(" ".join(text for (_, text, _), p in zip(page, prob) if p >= 0.5))
    return out


def fit(df: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = 300, max_chars: int = 20_000) -> Model:
    """Train on about ``sample`` pages of at most ``max_chars`` characters, chosen by a hash of their identifier."""
    known = df.filter(F.col(html_col).isNotNull() & (F.length(html_col) <= max_chars)).select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html"))
    count = known.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, count)) * (1 << 30))
    return train([r.html for r in known.filter(share).orderBy("id").limit(2 * sample).collect()])


def main_text(df: DataFrame, model: Model, html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of each whole page as ``out`` (replacing a column of that name).

    Null and empty pages and pages without a main block have an empty text; a page cut off
    inside a tag loses that tag alone.  Rows, repeated ones included, and other columns
    stay; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)   # tables of fixed size

    @pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series(extract(list(pages), shared.value), dtype=object)

    found = free_name(df, "found")
    return df.withColumn(found, of(F.col(html_col))).withColumn(out, F.col(found)).drop(found)
