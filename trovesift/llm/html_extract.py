"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Lafferty, McCallum & Pereira (2001). A page becomes a row of leaf blocks: runs of text
between the bounds of block elements. A block's features are its ancestors' tags, the
words of their class, id and role, and the shape of its text and of its neighbours'; a
state says whether it belongs to the main text. What one state says about the next is
learned apart for blocks of the same parent and for others. Weights are learned on
labelled pages (html, text) by stochastic gradient ascent of the penalised conditional
likelihood, with forward and backward sums; Viterbi's algorithm decodes a page.

Parsing takes one pass, whatever the markup: nothing is looked for twice, and what a
block inherits is a tuple that it shares with its parent.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovesift.llm.page_samples import labelled_page
from trovesift.llm.shared import map_beside

# Elements of HTML by their role in the flow.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li"
    " main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page; those of the second kind end with the page if they aren't closed.
SILENT, RAW = frozenset("noscript template svg math iframe object".split()), frozenset("script style textarea title".split())
#: An element of these names ends an open one of the same group.
SIBLINGS = {name: group for group in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",)) for name in group}
PLAIN = frozenset("html body div span b i em strong u small font center".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)""", re.I)
_CLOSING = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in SILENT | RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SHORT = 12


class _Open:
    """An open element: its name, its number on the page, and the features that all inside it have."""

    __slots__ = ("name", "number", "features", "link")

    def __init__(self, name: str, number: int, features: tuple[str, ...], link: bool) -> None:
        self.name, self.number, self.features, self.link = name, number, features, link


class Block:
    """A leaf block: its text, tag, parent element, inherited features, and the share of its letters in links."""

    __slots__ = ("text", "tag", "parent", "features", "link")

    def __init__(self, text: str, tag: str, parent: int, features: tuple[str, ...], link: float) -> None:
        self.text, self.tag, self.parent, self.features, self.link = text, tag, parent, features, link


def _element_features(name: str, attributes: str) -> tuple[str, ...]:
    out = [] if name in PLAIN else [f"in={name}"]
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            out.append("hidden")
        elif key in ("class", "id", "role", "itemprop", "aria-label"):
            out.extend(f"as={w.lower()}" for w in _WORD.findall(value))
    return tuple(dict.fromkeys(out))


def blocks(page: str, known: dict | None = None) -> list[Block]:
    """The leaf blocks with a text. Only features in `known` are kept, if that is given."""
    out, stack, counts = [], [_Open("#", 0, (), False)], Counter()
    parts: list[str] = []
    linked = number = 0
    cache: dict[tuple[str, str], tuple[str, ...]] = {}
    unclosed: set[str] = set()

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text)
            parts.append(text)
            if stack[-1].link:
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            holders = (x for x in reversed(stack) if x.name in BLOCKS or x.name == "#")
            leaf = next(holders)
            out.append(Block(text, leaf.name, next(holders, leaf).number, stack[-1].features, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def pop_to(name: str) -> None:
        while True:
            top = stack.pop()
            counts[top.name] -= 1
            if top.name == name:
                return

    at = 0
    while (found := _TOKEN.search(page, at)) is not None:
        say(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            if name in BLOCKS:
                flush()
            if counts[name]:
                pop_to(name)
            continue
        if name in _CLOSING and name not in unclosed:
            end = _CLOSING[name].search(page, at)
            if end is not None:
                close = page.find(">", end.end() - 1)
                at = close + 1 if close >= 0 else len(page)
            elif name in RAW:
                at = len(page)
            else:
                unclosed.add(name)
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
            if counts["p"] and name not in ("button", "label", "select", "option", "optgroup"):
                pop_to("p")
            for other in SIBLINGS.get(name, ()):
                # Only within the innermost list or table.
                holder = next((x.name for x in reversed(stack[-64:]) if x.name in (other, "ul", "ol", "dl", "menu", "table", "select")), None)
                if holder == other:
                    pop_to(other)
        if name in VOID or found[3].endswith("/") and name not in BLOCKS:
            continue
        if name == "a" and counts["a"]:
            pop_to("a")
        key = name, found[3]
        if key not in cache:
            cache[key] = tuple(x for x in _element_features(name, found[3]) if known is None or x in known)
        above = stack[-1]
        own = tuple(x for x in cache[key] if x not in above.features)
        number += 1
        stack.append(_Open(name, number, above.features + own if own else above.features, name == "a" or above.link))
        counts[name] += 1
    say(page[at:])
    flush()
    return out


def _shape(text: str, link: float) -> list[str]:
    words = text.split()
    n, size = len(words), len(text)
    letters = max(1, sum(map(str.isalpha, text)))
    out = [
        f"words={min(8, n.bit_length())}", f"link={0 if link == 0 else 1 + min(3, int(link * 4))}", f"capital={min(4, 5 * sum(w[0].isupper() for w in words) // n)}",
        f"marks={min(4, sum(map(text.count, '.!?;,:')))}", f"end={text[-1] if text[-1] in '.!?…:,' else ''}", f"odd={min(3, 8 * (size - letters - n + 1) // size)}",
    ]
    out.extend(f"sign={c}" for c in "©®|»›·•@" if c in text)
    if n <= _SHORT:
        out.extend(f"says={w.strip('.,:;!?()').lower()}" for w in set(words))
    return out


def page_features(found: list[Block]) -> list[list[str]]:
    """All features of each block."""
    count, out = len(found), []
    size = [min(6, x.text.count(" ").bit_length()) for x in found]
    for k, x in enumerate(found):
        own = ["bias", f"tag={x.tag}", f"place={5 * k // count}", f"before={size[k - 1] if k else 'none'}", f"after={size[k + 1] if k + 1 < count else 'none'}"]
        out.append([*own, *_shape(x.text, x.link), *x.features])
    return out


def siblings(found: list[Block]) -> list[int]:
    """Whether each block has the same parent as the one before it."""
    return [int(k > 0 and x.parent == found[k - 1].parent) for k, x in enumerate(found)]


@dataclass
class PageModel:
    """weights[feature]: scores of the states 0 (not main text) and 1; bonds[sibling][a][b]: of b after a."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    bonds: tuple = (((0.0, 0.0), (0.0, 0.0)),) * 2

    def emissions(self, features: list[list[str]]) -> list[tuple[float, float]]:
        out, none = [], (0.0, 0.0)
        for names in features:
            a = b = 0.0
            for x in names:
                u, v = self.weights.get(x, none)
                a += u
                b += v
            out.append((a, b))
        return out

    def decode(self, found: list[Block]) -> list[int]:
        kinds = siblings(found)
        return viterbi(self.emissions(page_features(found)), [self.bonds[k] for k in kinds])

    def extract(self, page: str) -> str:
        found = blocks(page, self.weights)
        return " ".join(x.text for x, state in zip(found, self.decode(found), strict=True) if state)


def viterbi(emissions: list[tuple[float, float]], bonds: list) -> list[int]:
    """The states with the highest score in all, bonds[k] between blocks k - 1 and k; state 0 of equals."""
    if not emissions:
        return []
    a, b = emissions[0]
    back = []
    for (u, v), bond in zip(emissions[1:], bonds[1:], strict=True):
        to_a, to_b = (a + bond[0][0], b + bond[1][0]), (a + bond[0][1], b + bond[1][1])
        back.append((int(to_a[1] > to_a[0]), int(to_b[1] > to_b[0])))
        a, b = u + max(to_a), v + max(to_b)
    state = int(b > a)
    out = [state]
    for step in reversed(back):
        state = step[state]
        out.append(state)
    return out[::-1]


def _log_sum(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log(math.exp(a - high) + math.exp(b - high))


def marginals(emissions: list[tuple[float, float]], bonds: list) -> tuple[float, list[tuple[float, float]], list[np.ndarray]]:
    """log of the sum over all state rows, the chances of the states at each block, and those of each pair of states at blocks k - 1 and k (zero for k = 0)."""
    n = len(emissions)
    forward = [emissions[0]]
    for (u, v), bond in zip(emissions[1:], bonds[1:], strict=True):
        a, b = forward[-1]
        forward.append((u + _log_sum(a + bond[0][0], b + bond[1][0]), v + _log_sum(a + bond[0][1], b + bond[1][1])))
    backward = [(0.0, 0.0)] * n
    for k in range(n - 2, -1, -1):
        bond, u, v = bonds[k + 1], emissions[k + 1][0] + backward[k + 1][0], emissions[k + 1][1] + backward[k + 1][1]
        backward[k] = (_log_sum(bond[0][0] + u, bond[0][1] + v), _log_sum(bond[1][0] + u, bond[1][1] + v))
    total = _log_sum(*forward[-1])
    chances = [(math.exp(f[0] + g[0] - total), math.exp(f[1] + g[1] - total)) for f, g in zip(forward, backward, strict=True)]
    pairs = [np.zeros((2, 2))]
    for k in range(1, n):
        pairs.append(np.array([[math.exp(forward[k - 1][i] + bonds[k][i][j] + emissions[k][j] + backward[k][j] - total) for j in (0, 1)] for i in (0, 1)]))
    return total, chances, pairs


def label_blocks(found: list[Block], text: str, ways: int = 16) -> list[int]:
    """Which blocks make up the main text: of the ways to find blocks in it one after another, the one that covers most; the `ways` best are followed.

    A way may leave out up to 1000 characters of the text before a block of over 40.
    """
    text = " ".join(text.split())
    states: dict[int, tuple[int, tuple]] = {0: (0, ())}  # by place in the text: how much is covered, by which blocks
    for k, block in enumerate(x.text for x in found):
        more = {}
        for at, (covered, chosen) in states.items():
            place = text.find(block, at, at + len(block) + (1000 if len(block) > 40 else 0))
            end = place + len(block)
            if place >= 0 and (end == len(text) or text[end] == " "):
                here = min(end + 1, len(text)), (covered + len(block), (k, chosen))
                if here[1][0] > more.get(here[0], (-1,))[0]:
                    more[here[0]] = here[1]
        for at, way in more.items():
            if way[0] > states.get(at, (-1,))[0]:
                states[at] = way
        if len(states) > ways:
            states = dict(sorted(states.items(), key=lambda x: -x[1][0])[:ways])
    labels, chosen = [0] * len(found), max(states.values(), key=lambda x: x[0])[1]
    while chosen:
        labels[chosen[0]] = 1
        chosen = chosen[1]
    return labels


def train(pages: list[tuple[str, str]], epochs: int = 8, rate: float = 0.3, penalty: float = 2e-4, least: int = 4, least_word: int = 25, seed: int = 13) -> PageModel:
    """Fit on (html, main text) pages. Features on fewer than `least` pages, and words on fewer than `least_word`, are not learned; without pages nothing is main text."""
    data = []
    for page, text in pages:
        found = blocks(page)
        if found:
            data.append((page_features(found), siblings(found), label_blocks(found, text)))
    seen = Counter(x for features, *_ in data for x in {y for names in features for y in names})
    number = {x: k for k, x in enumerate(sorted(x for x, n in seen.items() if n >= (least_word if x.startswith("says=") else least)))}
    coded = [([np.array([number[x] for x in names if x in number], np.int64) for names in features], kinds, labels) for features, kinds, labels in data]
    weights, bonds = np.zeros((len(number), 2)), np.zeros((2, 2, 2))
    speed, bond_speed = np.full((len(number), 2), 1e-2), np.full((2, 2, 2), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(coded)).tolist():
            rows, kinds, labels = coded[k]
            ids, sizes = np.concatenate(rows), [len(r) for r in rows]
            emissions = np.add.reduceat(weights[ids], np.cumsum([0, *sizes[:-1]])).tolist()
            told = bonds.tolist()
            _, chances, pairs = marginals(emissions, [told[x] for x in kinds])
            expected = np.zeros((2, 2, 2))
            for j in range(1, len(labels)):
                expected[kinds[j]] += pairs[j]
                expected[kinds[j], labels[j - 1], labels[j]] -= 1
            slope = np.array(chances)
            slope[np.arange(len(labels)), labels] -= 1
            spread = np.repeat(slope, sizes, axis=0)
            own, place = np.unique(ids, return_inverse=True)
            step = np.zeros((len(own), 2))
            np.add.at(step, place, spread)
            step += penalty * len(rows) * weights[own]
            speed[own] += step * step  # Adagrad (Duchi et al., 2011)
            weights[own] -= rate * step / np.sqrt(speed[own])
            bond_speed += expected * expected
            bonds -= rate * expected / np.sqrt(bond_speed)
    return PageModel({x: (float(weights[k, 0]), float(weights[k, 1])) for x, k in number.items()}, tuple(tuple(map(tuple, table)) for table in bonds.tolist()))


def labelled_pages(spark: SparkSession, count: int = 1500, seed: int = 29) -> DataFrame:
    """(page, html, text): invented pages of many layouts with their main texts, the label."""

    def run(batches):
        for batch in batches:
            rows = [labelled_page(seed, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], ["page", "html", "text"])

    return spark.range(count, numPartitions=4).withColumnRenamed("id", "page").mapInArrow(run, "page long, html string, text string")


def fit(labelled: DataFrame, most: int = 2000) -> PageModel:
    """The model of at most `most` labelled pages (html, text), the first by a seeded hash of the html; trained in a task, only the model comes to the driver."""
    order = F.xxhash64(F.lit("pages"), "html")
    sample = labelled.where("html is not null and text is not null").select("html", "text").orderBy(order, "html", "text").limit(most)

    def run(batches):
        rows = [(h, t) for batch in batches for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], ["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else PageModel()


def extract_text(pages: DataFrame, model: PageModel) -> DataFrame:
    """`pages` (html, ...) with text, the main text of the whole html, and n_chars, its code points.

    Null and empty html, and pages without main text, give an empty text and 0. Rows are
    decoded alone, so repeated rows give equal results; columns of these names are
    replaced, others stay; an empty table gives an empty result. A page is held whole by a task.
    """
    told = pages.sparkSession.sparkContext.broadcast(model)

    def function(column):
        texts = [told.value.extract(x) if x else "" for x in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

    return map_beside(pages.withColumn("html", F.col("html").cast("string")), function, "text string, n_chars long", column="html")
