"""HTML extraction by minimum cut: the text of a page is split into blocks, and a max-flow separates content from boilerplate.

A block's terminal capacities are the costs of a logistic classifier of what the block looks like (length, links, marks, element) and of
what the elements and names around it say; names are features with learned weights like the others. Smoothness edges join blocks that
follow each other and neighbours under one parent element. Weights are fitted on blocks of sampled pages that elements or names mark, each
counted once as it is and once as if nothing named it; they are drawn to the default weights, which hold where pages mark nothing. The
strength of the edges is then chosen on sampled pages that the fit has not seen: the one that errs least where all is named, and of these
the one that errs least where half of the blocks lose what names say, then the one nearest the default. Pages are handled one by one in map tasks.

Defined results: a null or empty page, or one without content, has an empty text; comments, scripts, styles, titles and the like hold no
text, and a self-closing ``svg`` or ``math`` ends there; a tag that never ends takes the rest of the page with it, an element that never ends lasts to the end of its parent;
``br`` is white space; character references without a semicolon are decoded as browsers do; a block whose costs tie is boilerplate;
repeated pages each give a row; an empty table gives none; a long page is cut whole, in time near linear in its blocks; further
columns and clashing names do not matter.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages that a model is fitted on, about; those of the smallest hashes, of at most so many characters.
SAMPLE_PAGES, SAMPLE_CHARACTERS = 400, 300_000
#: Smoothness edges: blocks in a row, and neighbours under one parent, as parts of the strength that fit() chooses from these.
NEXT, SIBLING = 0.4, 0.6
STRENGTHS = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0)
#: How strongly learned weights are drawn to the default ones.
PULL = 2e-3

# Element names of HTML and the roles and words that pages commonly name their parts by.
_SILENT = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|select|textarea|title"
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav aside footer form menu dialog button fieldset search".split())
_IN = frozenset("article main".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright"
    " disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager"
    " pagination popup promo promoted promotion recommended related replies respond rail search share sharing sidebar signin signup skip social"
    " sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
_IN_WORDS = frozenset("article articlebody body content entry main maincontent post story".split())
# Words that add nothing to a name beside them.
_GENERIC = frozenset(
    "area bar block bottom box btn button buttons col column container extra field fields fixed form global group holder id inner item items js left"
    " line link links list mobile module page panel primary right row secondary section site slot sticky text title top unit wrap wrapper zone".split()
)
_SLUGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd".split())
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>|<({_SILENT})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_REST = re.compile(r"<[a-zA-Z/!][^>]*\Z")
_said: dict[tuple[str, str], tuple[int, bool]] = {}


def _name_says(name: str) -> tuple[int, bool]:
    """-1, 1 or 0 of one class or id, and whether it hints at boilerplate: a word for it beside words that are about something else."""
    words = {w.lower() for w in _NAME.findall(name)}
    out, inside = words & _OUT_WORDS, words & _IN_WORDS
    if out and not (inside and out <= {"header"}):
        return (-1, False) if words <= _OUT_WORDS | _IN_WORDS | _GENERIC else (0, True)
    return (1, False) if inside else (0, False)


def element_says(tag: str, attributes: str) -> tuple[int, bool]:
    """-1 for boilerplate, 1 for content, 0 for nothing, 2 for a header, which depends: of an element by its name and attributes.
    Also whether a name hints at boilerplate. The id of a heading or paragraph is an anchor and names no part."""
    known = _said.get((tag, attributes))
    if known is not None:
        return known
    says, hint = -1 if tag in _OUT else 1 if tag in _IN else 2 if tag == "header" else 0, False
    if attributes and tag not in ("html", "body"):
        named = set()
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                says = -1
            elif name == "role":
                says = -1 if value.lower() in _OUT_ROLES else 1 if value.lower() in ("main", "article") else says
            elif name == "class" or name == "id" and tag not in _SLUGS:
                for part in value.split():
                    said, hinted = _name_says(part)
                    named.add(said)
                    hint = hint or hinted
        if says in (0, 2) and named & {-1, 1}:
            # Names that contradict each other say nothing.
            says = says if named >= {-1, 1} else -1 if -1 in named else 1
    if len(_said) > 50_000:
        _said.clear()
    _said[tag, attributes] = says, hint
    return says, hint


class Block(NamedTuple):
    text: str
    element: str
    zone: int  # what elements and names around it say
    hint: bool
    parent: int
    links: float  # share of characters in links


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # name, zone, number, hint
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name in the stack
    parts: list[str] = []
    linked, in_link, number, last = 0, False, 0, 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                name, zone, _, hint = stack[-1]
                out.append(Block(text, name, zone, hint, stack[-2][2] if len(stack) > 1 else 0, min(1.0, linked / max(1, len(raw)))))
            parts.clear()
        linked = 0

    def leave(k: int) -> None:
        for name, *_ in stack[k:]:
            places[name].pop()
        del stack[k:]

    for m in _TOKEN.finditer(page):
        start = m.start()
        if start > last:
            parts.append(page[last:start])
            if in_link:
                linked += start - last
        last = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in _BLOCK
        if block:
            flush()
            in_link = False
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not m[2]
        if tag in _VOID:
            continue
        if m[2]:
            # An end tag closes the innermost element of its name; a block's does not reach out of the body.
            k = places[tag][-1] if places[tag] else 0
            if k and not (block and any(places[x] and places[x][-1] > k for x in ("body", "html"))):
                if not block:
                    flush()
                leave(k)
            continue
        says, hint = element_says(tag, m[4].strip())
        if not block and says in (0, 2):
            continue
        if not block:
            flush()
        else:
            if stack[-1][0] == "p":
                leave(len(stack) - 1)
            for name in _IMPLIED.get(tag, ()):
                if stack[-1][0] == name:
                    leave(len(stack) - 1)
        above = stack[-1][1]
        if says == 2:
            says = 0 if above == 1 else -1
        number += 1
        places[tag].append(len(stack))
        stack.append((tag, above if above == -1 or not says else says, number, hint or stack[-1][3]))
    if last < len(page):
        tail = _REST.sub("", page[last:])
        parts.append(tail)
        if in_link:
            linked += len(tail)
    flush()
    return out


def features(b: Block) -> list[float]:
    """What a block looks like, and what is said around it: the last NAMED ones."""
    words = b.text.split(" ")
    n = len(words)
    return [
        1.0, np.log1p(n), b.links, float(b.element == "p"), float(b.element[:1] == "h" and b.element[1:].isdigit()), float(b.element in ("li", "td", "dd")),
        float(b.text[-1] in ".!?…\"”"), sum(w[:1].isupper() for w in words) / n, len(b.text) / n / 10, float("©" in b.text or "|" in b.text),
        float(b.zone == -1), float(b.zone == 1), float(b.hint),
    ]


NAMED = 3


@dataclass
class Model:
    weights: np.ndarray
    strength: float

    def net(self, x: np.ndarray) -> list[float]:
        """Source less sink capacity: log P / (1 - P) is what the costs of either label leave after their common part."""
        return np.clip(x @ self.weights, -30, 30).tolist()


#: Where pages mark no part that a model could be fitted on.
DEFAULT = Model(np.array([-1.5, 0.9, -3.0, 0.8, 0.5, -0.8, 0.8, -0.5, 0.0, -1.5, -5.0, 4.0, -0.7]), 1.0)


def _settled(net: list[float], room: list[dict[int, float]]) -> tuple[list[int], list[float]]:
    """Labels (1, -1, or 0 for open) of nodes that outweigh all their edges, and the capacities of the others with these fixed.

    Such a node has its own sign in a minimum cut, and its edges then only pull at its neighbours.
    """
    left, label, weight = list(net), [0] * len(net), [sum(r.values()) for r in room]
    queue = deque(range(len(net)))
    while queue:
        i = queue.popleft()
        if label[i] or abs(left[i]) < weight[i] or not (left[i] or room[i]):
            continue
        label[i] = 1 if left[i] > 0 else -1
        for j, w in room[i].items():
            if not label[j]:
                left[j] += w * label[i]
                weight[j] -= w
                queue.append(j)
    return label, left


def max_flow_labels(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut; the smallest such side.

    net: source capacity less sink capacity of each node, as the smaller of the two flows straight through. Nodes that outweigh their
    edges are settled first. For the others, flow goes from all nodes of surplus at once to nodes of deficit, in phases of shortest
    paths with room left.
    """
    n, eps = len(net), 1e-9
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w > 0:
            room[i][j] = room[i].get(j, 0.0) + w
            room[j][i] = room[j].get(i, 0.0) + w
    label, left = _settled(net, room)
    free = [i for i in range(n) if not label[i]]
    near = {i: [j for j in room[i] if not label[j]] for i in free}
    while True:
        level = {i: 0 for i in free if left[i] > eps}
        starts, queue, ends = list(level), deque(level), False
        while queue:
            i = queue.popleft()
            for j in near[i]:
                if j not in level and room[i][j] > eps:
                    level[j] = level[i] + 1
                    ends = ends or left[j] < -eps
                    queue.append(j)
        if not ends:
            break
        tried = dict.fromkeys(level, 0)
        for s in starts:
            path = [s]
            while path and left[s] > eps:
                i = path[-1]
                if left[i] < -eps:
                    flow = min(left[s], -left[i], min(room[a][b] for a, b in zip(path, path[1:])))
                    left[s] -= flow
                    left[i] += flow
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= flow
                        room[b][a] += flow
                    # Back to before the first edge without room.
                    path = path[: next((k + 1 for k, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= eps), len(path))]
                    continue
                k = tried[i]
                while k < len(near[i]) and not (level.get(near[i][k]) == level[i] + 1 and room[i][near[i][k]] > eps):
                    k += 1
                tried[i] = k
                if k < len(near[i]):
                    path.append(near[i][k])
                else:
                    path.pop()
                    if path:
                        tried[path[-1]] += 1
    return [label[i] > 0 or i in level for i in range(n)]


def joined(parents: list[int], strength: float) -> list[tuple[int, int, float]]:
    """The smoothness edges of blocks with these parents."""
    edges = [(i, i + 1, NEXT * strength) for i in range(len(parents) - 1)]
    before: dict[int, int] = {}
    for i, p in enumerate(parents):
        if p in before:
            edges.append((before[p], i, SIBLING * strength))
        before[p] = i
    return edges


def label(found: list[Block], model: Model) -> list[bool]:
    """Whether each block of a page is content."""
    if not found:
        return []
    return max_flow_labels(model.net(np.array([features(b) for b in found])), joined([b.parent for b in found], model.strength))


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, label(found, model), strict=True) if keep)


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least balanced logistic loss, drawn to the default weights: Newton steps on the difference from these."""
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w = DEFAULT.weights.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + PULL * np.eye(len(w)), x.T @ (share * (p - y)) + PULL * (w - DEFAULT.weights))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _masked(x: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
    out = x.copy()
    out[rows, -NAMED:] = 0
    return out


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", sample: int = SAMPLE_PAGES, characters: int = SAMPLE_CHARACTERS) -> Model:
    """The classifier and the strength of the edges, from about ``sample`` pages of at most ``characters``."""
    share = sample / max(1, pages.count())
    place = (F.xxhash64(F.col(key).cast("string")).cast("double") + 2.0**63) / 2.0**64
    chosen = pages.where((place < F.lit(share)) & (F.length(page) <= characters)).select(place.alias("place"), F.col(page).alias("page"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [blocks(p) for p in b["page"]]
            x = [np.array([features(k) for k in f], dtype="<f8").tobytes() for f in found]
            yield pd.DataFrame({"place": b["place"], "x": x, "zone": [[k.zone for k in f] for f in found], "parent": [[k.parent for k in f] for f in found]})

    rows = chosen.mapInPandas(measure, "place double, x binary, zone array<int>, parent array<int>").toPandas().sort_values("place", kind="stable")
    width = len(DEFAULT.weights)
    seen = [(np.frombuffer(x, dtype="<f8").reshape(-1, width), np.array(z, dtype=int), list(p)) for x, z, p in zip(rows["x"], rows["zone"], rows["parent"], strict=True)]
    fitted = [f for k, f in enumerate(seen) if k % 4]
    held = [f for k, f in enumerate(seen) if not k % 4]
    zones = np.concatenate([z for _, z, _ in fitted]) if fitted else np.zeros(0, dtype=int)
    if not {-1, 1} <= set(zones.tolist()):
        return DEFAULT
    x = np.concatenate([v for v, _, _ in fitted])[zones != 0]
    y = (zones[zones != 0] > 0).astype(float)
    weights = _weights(np.concatenate((x, _masked(x, slice(None)))), np.concatenate((y, y)))
    rng = np.random.default_rng(17)
    trials = [(v, _masked(v, rng.random(len(v)) < 0.5), z, p) for v, z, p in held]

    def errors(strength: float) -> tuple[int, int]:
        model, wrong = Model(weights, strength), [0, 0]
        for whole, half, z, p in trials:
            for k, v in enumerate((whole, half)):
                kept = np.array(max_flow_labels(model.net(v), joined(p, strength)), dtype=bool)
                wrong[k] += int((kept != (z > 0))[z != 0].sum())
        return wrong[0], wrong[1]

    return Model(weights, min(STRENGTHS, key=lambda s: (*errors(s), abs(s - DEFAULT.strength))))


def extract(page: Column, model: Model) -> Column:
    """The main text of a page, empty if it has none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, model) for p in pages], dtype=object)

    return run(page)
