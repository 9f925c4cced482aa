"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the leaf texts between block-level tags, in page
order, white space joined, character references decoded. Each block becomes
a vector of its tag path (tags, classes and ids, hashed), all its words
(hashed) and a few lengths. A bidirectional LSTM in numpy reads the whole
sequence, so every block is classified with the context of the entire document,
and the blocks labelled as main text are joined with line feeds.

The labeller is fitted where it runs, on at most ``sample_pages`` pages of
the table (chosen by hash) and on pages assembled from their texts in other
layouts. Labels of the sample come from the names of the enclosing elements,
those of assembled pages from how they were made; half of these have no telling
names at all, only lists of links, short lines, and text in plain elements, so
that the network learns to do without names.

Pages are scanned once from start to end, in time proportional to their length
however broken they are. A tag ends at the first ">" outside quotes; if a quote
is never closed it counts as a letter, and if quotes leave a tag without an end,
quotes count no more on that page. A "<" that begins no tag is text.

Null or empty html, and pages without main text, give an empty text. Repeated
rows are each returned; other columns are ignored. Nothing is cut off, however
long a page is.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH_DIMS, WORD_DIMS, OTHER_DIMS = 96, 32, 6
DIMS = PATH_DIMS + WORD_DIMS + OTHER_DIMS
HIDDEN = 16
SAMPLE_PAGES = 192
SAMPLE_CHARS = 1 << 20  # longer pages are no part of the sample while there are others
SAMPLE_WEIGHT = 2  # how often the sample itself trains besides
LAYOUTS = 4  # assembled pages for each page of the sample, half of them without telling names
#: White space of HTML and, after decoding, of Unicode.
SPACE = re.compile(r"\s+")
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose contents are no part of the page's text.
SKIPPED = set("script style noscript template iframe svg textarea select title".split())
#: Elements that stay inside a block, and those without an end tag.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same kind closes.
CLOSES_SELF = set("p li dt dd tr td th option".split())
#: Names that tell main text from the rest of a page, for the labels of the sample.
MAIN_NAMES = set("article main content post entry story maincontent articlebody".split())
OTHER_NAMES = set(
    "nav header footer aside form button dialog menu sidebar ad ads advert advertisement banner sponsored promo comment comments disqus reply cookie consent notice alert popup modal newsletter subscribe share social related recommended breadcrumb breadcrumbs pagination toolbar search login widget copyright legal navigation complementary contentinfo".split()
)


#: Marks on assembled pages; never seen by the network.
MARKED, UNMARKED = "=main", "=other"


class Path:
    """What encloses a block: hashed names, depth, and where the names put it
    (1 in main text, 2 in something else, 0 neither). Each adds to its parent's,
    so a deep path costs no more than a flat one."""

    __slots__ = ("slots", "depth", "place")

    def __init__(self, parent: Path | None = None, names: tuple[str, ...] = ()):
        self.slots = np.zeros(PATH_DIMS, np.float32) if parent is None else parent.slots
        self.depth = 0 if parent is None else parent.depth
        self.place = 0 if parent is None else parent.place
        marks = {MARKED, UNMARKED}.intersection(names)
        if marks:  # only says how an assembled page was made
            self.place = 2 if UNMARKED in marks or self.place == 2 else 1
        elif names:
            main, other = MAIN_NAMES.intersection(names), OTHER_NAMES.intersection(names[1:])
            self.place = 2 if self.place == 2 or names[0] in OTHER_NAMES or other and not main else max(self.place, int(bool(main)))
            self.depth += 1
            self.slots = self.slots.copy()
            self.slots[[slot(n, PATH_DIMS) for n in names]] = 1


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked = path, text, linked


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the parts of its class, id and role."""
    out = [tag]
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        out += [x for x in re.split(r"[\s_-]+", (m[2] or m[3] or m[4] or "").lower()) if x]
    return tuple(out)


def tags(page: str):
    """(start, end, name, closing, attributes) of every tag, comment and skipped
    element, in order; the name is empty but for tags."""
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
            yield start, at, "", False, ""
            continue
        m = NAME.match(page, start + 1)
        if not m:
            at = start + 1
            continue
        end = -1
        look = m.end()
        while quotes and (stop := STOP.search(page, look)):
            if stop[0] == ">":
                end = stop.start()
                break
            other = page.find(stop[0], stop.end())
            look = stop.end() if other < 0 else other + 1
        if end < 0:
            quotes = False
            end = page.find(">", m.end())
            if end < 0:
                return
        at = end + 1
        name, closing = m[1].lower(), page[start + 1] == "/"
        if name in SKIPPED and not closing:
            last = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = len(page) if last is None else last.end()
            yield start, at, "", False, ""
        else:
            yield start, at, name, closing, page[m.end() : end]


def blocks(page: str | None) -> list[Block]:
    found: list[Block] = []
    top = Path()
    stack: list[tuple[str, Path]] = []
    opened: Counter = Counter()
    text: list[str] = []
    linked = 0
    page = page or ""

    def close():
        nonlocal linked
        if text:
            joined = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                found.append(Block(stack[-1][1] if stack else top, joined, linked))
            text.clear()
        linked = 0

    def cut(k: int):
        opened.subtract(t for t, _ in stack[k:])
        del stack[k:]

    at = 0
    for start, end, tag, closing, attributes in tags(page):
        if start > at:
            text.append(page[at:start])
            if any(t == "a" for t, _ in stack[-3:]):
                linked += start - at
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
        else:
            close()
        if tag in VOID:
            continue
        if closing:
            if opened[tag] > 0:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in CLOSES_SELF and opened[tag] > 0:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    cut(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if not attributes.endswith("/"):
            parent = stack[-1][1] if stack else top
            stack.append((tag, parent if tag in INLINE else Path(parent, names_of(tag, attributes))))
            opened[tag] += 1
    if at < len(page):
        text.append(page[at:])
    close()
    return found


_slots: dict[tuple[str, int], int] = {}


def slot(name: str, dims: int) -> int:
    """A hash of the name, remembered."""
    found = _slots.get((name, dims))
    if found is None:
        if len(_slots) > 100_000:
            _slots.clear()
        found = _slots[name, dims] = zlib.crc32(name.encode("utf-8", "replace")) % dims
    return found


def vectors(found: list[Block]) -> np.ndarray:
    """One row per block."""
    x = np.zeros((len(found), DIMS), np.float32)
    for k, (row, b) in enumerate(zip(x, found, strict=True)):
        row[:PATH_DIMS] = b.path.slots
        words = b.text.lower().split()
        # every word counts; of long blocks the mean, so that their length does not drown the rest
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount([slot(w, WORD_DIMS) for w in words], minlength=WORD_DIMS) * (0.25 * min(1.0, 16 / max(1, len(words))))
        row[-OTHER_DIMS:] = (min(1.0, len(b.text) / 200), min(1.0, len(words) / 40), min(1.0, b.linked / max(1, len(b.text))), float(b.text[-1] in ".!?\"'"), k / len(found), min(b.path.depth, 40) / 8)
    return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Weights of the two directions and of the output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in ("f", "b"):
            self.p[f"{d}x"] = r.normal(0, 0.15, (DIMS, 4 * HIDDEN))
            self.p[f"{d}h"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            self.p[f"{d}b"] = bias
        self.p["o"] = r.normal(0, 0.15, 2 * HIDDEN)
        self.p["c"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time (T, B, H) for x (T, B, D); masked steps carry the state on."""
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        xw = x @ self.p[f"{d}x"] + self.p[f"{d}b"]
        for t in steps:
            z = xw[t] + h @ self.p[f"{d}h"]
            s = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = np.where(m, f * c + i * g, c)
            tc = np.tanh(new_c)
            new_h = np.where(m, o * tc, h)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out

    def back(self, x, kept, dout, d, grads) -> None:
        dh = np.zeros((x.shape[1], HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, g, tc, m in reversed(kept):
            dh = dh + dout[t]
            do, live = dh * tc, m
            dct = np.where(live, dc + dh * o * (1 - tc**2), dc)
            dz = np.hstack([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g**2)]) * live
            grads[f"{d}x"] += x[t].T @ dz
            grads[f"{d}h"] += h.T @ dz
            grads[f"{d}b"] += dz.sum(0)
            dh = np.where(live, dz @ self.p[f"{d}h"].T, dh)
            dc = np.where(live, dct * f, dc)

    def probabilities(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """For each page the probability that a block is main text. Pages of
        like lengths run together, at most ``cells`` padded blocks at once."""
        out: list = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            # the longest page left sets the length of the batch
            longest = len(pages[order[-1]])
            batch = order[-max(1, cells // longest) :]
            del order[-len(batch) :]
            x, mask = padded([pages[k] for k in batch])
            h = np.concatenate([self.run(x, mask, "f"), self.run(x, mask, "b")], axis=2)
            p = sigmoid(h @ self.p["o"] + self.p["c"])
            for n, k in enumerate(batch):
                out[k] = p[: len(pages[k]), n]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 16, size: int = 32, rate: float = 0.01, seed: int = 7) -> Labeller:
        r = random.Random(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        batches = [order[k : k + size] for k in range(0, len(order), size)]
        for _ in range(epochs):
            r.shuffle(batches)
            for batch in batches:
                x, mask = padded([pages[k] for k in batch])
                # half of the pages without their words, anew each time, so that these are not learned by heart
                x[:, [r.random() < 0.5 for _ in batch], PATH_DIMS : PATH_DIMS + WORD_DIMS] = 0
                y = np.zeros(mask.shape, np.float32)
                for n, k in enumerate(batch):
                    y[: len(labels[k]), n] = labels[k]
                kf: list = []
                kb: list = []
                h = np.concatenate([self.run(x, mask, "f", kf), self.run(x, mask, "b", kb)], axis=2)
                err = np.where(mask, sigmoid(h @ self.p["o"] + self.p["c"]) - y, 0) / mask.sum()
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["o"] = np.einsum("tb,tbh->h", err, h)
                grads["c"] = np.array([err.sum()], np.float32)
                dh = err[:, :, None] * self.p["o"]
                self.back(x, kf, dh[:, :, :HIDDEN], "f", grads)
                self.back(x, kb, dh[:, :, HIDDEN:], "b", grads)
                step += 1
                for k in self.p:
                    m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                    m2[k] = 0.99 * m2[k] + 0.01 * grads[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, pages))
    x = np.zeros((length, len(pages), DIMS), np.float32)
    mask = np.zeros((length, len(pages)), bool)
    for n, p in enumerate(pages):
        x[: len(p), n] = p
        mask[: len(p), n] = True
    return x, mask


def labels_by_names(found: list[Block]) -> np.ndarray:
    """1 for blocks inside a main element and outside any other one; the labels of sample and assembled pages."""
    return np.array([b.path.place == 1 for b in found], np.float32)


def plain_layout(texts: list[str], r: random.Random) -> str:
    """A page with the given texts in elements whose names tell nothing: lists of
    links and short lines around text, in divisions, tables or the bare body."""
    e = entities.escape
    text = lambda: e(r.choice(texts))
    short = lambda n=6: e(" ".join(r.choice(texts).split()[: r.randint(1, n)]).rstrip(".,;:!?"))
    name = lambda: r.choice(("", "", f" class='{''.join(r.choices('bcdfghklmnprstaeiou', k=r.randint(4, 7)))}'"))
    link = lambda: f"<a href='/{r.randint(1, 99)}'>{short(3)}</a>"
    links = lambda: [link() for _ in range(r.randint(2, 8))]
    around = [
        lambda: f"<ul{name()}>" + "".join(f"<li>{x}</li>" for x in links()) + "</ul>",
        lambda: f"<div{name()}>" + " | ".join(links()) + "</div>",
        lambda: f"<p>{' '.join(links())}</p>",
        lambda: "<table><tr>" + "".join(f"<td>{x}</td>" for x in links()) + "</tr></table>",
        lambda: f"<div{name()}>{short()}</div>",
        lambda: f"<div{name()}><span>{short(4)}</span> <b>{r.randint(1990, 2030)}</b></div>",
        lambda: f"<p>{short(4)}: {link()}</p>",
        lambda: f"<div{name()}>{short(3)} <input name=q> <button>{short(2)}</button></div>",
    ]
    some = lambda n: "".join(f"<div class='{UNMARKED}'>{r.choice(around)()}</div>" if r.random() < 0.8 else "" for _ in range(r.randint(1, n)))
    parts = [f"<{t}{name()}>{short() if t in ('h1', 'h2') else text()}</{t}>" for t in r.choices(("p", "p", "p", "p", "div", "h2", "li", "blockquote"), k=r.randint(2, 9))]
    if r.random() < 0.6:
        parts.insert(0, f"<h1>{short()}</h1>")
    if r.random() < 0.2:
        parts = [text() + "<br><br>" + text()]
    main = f"<div class='{MARKED}'>{''.join(parts)}</div>"
    shape = r.choice(("{0}{1}{2}", "{0}<div{3}>{1}</div>{2}", "<div>{0}</div><div{3}><div{3}>{1}</div></div><div>{2}</div>", "<table><tr><td>{0}</td><td>{1}</td></tr></table>{2}", "<table><tr><td>{0}</td></tr><tr><td{3}>{1}</td><td>{2}</td></tr></table>", "{0}<section{3}>{1}</section>{2}", "<center>{0}{1}{2}</center>"))
    return "<html><body>" + shape.format(some(3), main, some(3), name()) + "</body></html>"


def other_layout(texts: list[str], r: random.Random) -> str:
    """A page with the given texts in an invented layout."""
    e = entities.escape
    text = lambda: e(r.choice(texts))
    short = lambda: e(" ".join(r.choice(texts).split()[: r.randint(1, 6)]))
    paragraphs = lambda n: "".join(f"<{t}>{text()}</{t}>" for t in r.choices(("p", "p", "p", "p", "h2", "li", "blockquote", "pre", "td"), k=n))
    junk = [
        lambda: "<nav><ul>" + "".join(f"<li><a href='/x'>{short()}</a></li>" for _ in range(r.randint(2, 8))) + "</ul></nav>",
        lambda: f"<header><h1>{short()}</h1><p>{text()}</p></header>",
        lambda: f"<footer>{text()}<p>{short()}</p></footer>",
        lambda: f"<aside><h3>{short()}</h3><p>{text()}</p></aside>",
        lambda: f"<form><label>{short()}</label><p>{text()}</p><button>{short()}</button></form>",
    ] + [lambda n=n: f"<{r.choice(('div', 'section', 'ul'))} {r.choice(('class', 'id'))}='{n}'><p>{text()}</p>{short()}</div>" for n in sorted(OTHER_NAMES - {"nav", "header", "footer", "aside", "form"})]
    pick = lambda n: [r.choice(junk)() for _ in range(r.randint(0, n))]
    main = r.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='content'>{}</div>", "<div class='post'>{}</div>", "<div class='entry-content'>{}</div>", "<main><article>{}</article></main>", "<div class='story'>{}</div>"))
    inner = [f"<h1>{short()}</h1>", *[paragraphs(r.randint(1, 4)) for _ in range(r.randint(1, 4))]]
    for j in pick(2):
        inner.insert(r.randint(1, len(inner)), j)
    return "<html><body>" + "".join(pick(5)) + main.format("".join(inner)) + "".join(pick(5)) + "</body></html>"


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, seed: int = 7) -> Labeller | None:
    """Fit on at most ``sample_pages`` pages and LAYOUTS times as many assembled ones."""
    order = F.xxhash64(id_col, html_col)
    usable = pages.where(F.length(html_col).between(1, SAMPLE_CHARS))
    # the sample has the lowest hashes: all but a few tasks need not send candidates
    share = 4 * sample_pages / max(1, pages.count())
    low = usable.where(order.cast("double") <= -(2.0**63) + share * 2.0**64) if share < 1 else usable
    sample = low.select(html_col).orderBy(order).limit(sample_pages).collect()
    if share < 1 and len(sample) < sample_pages:  # most pages are empty
        sample = usable.select(html_col).orderBy(order).limit(sample_pages).collect()
    if not sample:  # nothing but very long pages: a few of them
        sample = pages.where(F.length(html_col) > 0).select(html_col).orderBy(order).limit(4).collect()
    found = [b for b in (blocks(row[0]) for row in sample) if b]
    if not found:
        return None
    r = random.Random(seed)
    # pages whose names show no main text lend their texts, but are no examples: their main text may be unnamed
    named = [b for b in found if any(x.path.place == 1 for x in b)]
    made_pages = []
    for b in found:
        for k in range(LAYOUTS):
            layout = plain_layout if k % 2 else other_layout
            made = blocks(layout([x.text[:300] for x in b], r))
            if made:
                made_pages.append(made)
    # long pages train on a window: the cut is of the sample only
    parts = [b[k : k + 64] for b in named * (1 + SAMPLE_WEIGHT) + made_pages for k in range(0, len(b), 64)]
    return Labeller(seed).fit([vectors(b) for b in parts], [labels_by_names(b) for b in parts])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None, **options) -> DataFrame:
    """``(id, url, text, n_chars)`` for every page."""
    model = model or fit_labeller(pages, id_col, html_col, **options)
    source = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"))
    schema = T.StructType([source.schema[id_col], source.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches):
        m = sent.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [blocks(v.as_py()) for v in part.column(2)]
                chosen = m.probabilities([vectors(f) for f in found]) if m else [np.zeros(len(f)) for f in found]
                texts = ["\n".join(x.text for x, p in zip(f, ps, strict=True) if p > 0.5) for f, ps in zip(found, chosen, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)
