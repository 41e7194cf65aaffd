"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. A block is described by hashed vectors of its tag
path (tags, classes and ids of the elements around it) and of its words, and a few
proportions. A bidirectional LSTM reads the sequence in both directions, so each block is
labelled in the light of the whole page. The labeller is trained here, on a bounded sample
of the pages themselves: their own structure names most furniture, and variants with
other furniture and other names for the article teach what the sample lacks.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.words import word_hashes

SAMPLE = 240  # pages the labeller is trained on, by hash
SAMPLE_CHARS = 1 << 15  # of longer pages a window of leaf blocks is trained on
PATH, WORDS, PLAIN = 128, 48, 6
WORD_SCALE = 0.3
HIDDEN = 16
EPOCHS = 14
SEED = 9

# Elements that begin a block of their own.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noscript ol "
    "option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
# Elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page; the first run to its end where they are not closed.
RAW_TAGS = ("script", "style", "title", "textarea")
SKIPPED_TAGS = frozenset("template svg annotation annotation-xml iframe noscript select object canvas noframes".split())
# Elements, and words of class and id, that stand for page furniture.
FURNITURE_TAGS = frozenset("nav header footer aside form button dialog menu search".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended share social cookie cookies consent notice alert "
    "gdpr popup modal overlay newsletter subscribe signup login search comment comments disqus reply replies pager "
    "pagination copyright toolbar skip".split())
ARTICLE_TAGS = frozenset(("article", "main"))

# Quantifiers that give nothing back, and no "<" outside quotes, keep the scan linear.
_ATTRIBUTES = r"""(?:"[^"]*+"|'[^']*+'|[^'"<>])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW_TAGS)})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*+>|\Z)"
    rf"|<(/?)([a-z][^\s/<>]*+)({_ATTRIBUTES})>|<[!?/][^<>]*+>", re.I | re.S)
_CLOSED = re.compile(rf"</({'|'.join(sorted(SKIPPED_TAGS, key=len, reverse=True))})\s*+>", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")

Path = tuple[tuple[str, tuple[str, ...]], ...]
Block = tuple[Path, str, int]  # tag path, text, characters of it inside links


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = [a or b or c for a, b, c in _NAMES.findall(attributes)]
    return tuple(part for value in found for part in _PART.findall(value.lower()))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, character references decoded and white space closed up.

    Inline elements belong to the block around them; a line break is white space. A
    paragraph ends where the next block begins, and all that is open ends with the page.
    A skipped element that is closed by its own tag or nowhere hides nothing behind it.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    runs: list[str] = []
    links = depth = at = 0

    def close() -> None:
        nonlocal links
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                found.append((tuple(stack), text, min(links, len(text))))
            runs.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        runs.append(text)
        if depth:
            links += len(text.strip())

    ends: dict[str, list[int]] = {}
    for closed in _CLOSED.finditer(page):
        ends.setdefault(closed[1].lower(), []).append(closed.end())
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if tag in SKIPPED_TAGS and not token[2]:
            if tag == "svg" and token[4].endswith("/"):
                continue
            k = bisect.bisect_right(ends.get(tag, ()), at)
            if k < len(ends.get(tag, ())):
                at = ends[tag][k]
                continue
        if tag == "br":
            runs.append("\n")
        elif tag == "a":
            depth = 0 if token[2] else 1
        elif tag in BLOCK_TAGS:
            close()
            if token[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if stack and stack[-1][0] == "p" or stack and tag == stack[-1][0] and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    stack.pop()
                if tag not in VOID_TAGS:
                    stack.append((tag, _names(token[4])))
            depth = 0
    if at < len(page):
        add(page[at:])
    close()
    return found


def _bucket(name: str, n: int) -> int:
    return zlib.crc32(name.encode()) % n


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page a row per block: hashed tag path, hashed words, and proportions."""
    flat = [block for page in pages for block in page]
    words, offsets = word_hashes(pa.array([text for _, text, _ in flat], pa.large_string()))
    n_words = np.diff(offsets)
    owner = np.repeat(np.arange(len(flat)), n_words)
    counts = np.bincount(owner * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=len(flat) * WORDS).reshape(-1, WORDS)
    out = np.zeros((len(flat), PATH + WORDS + PLAIN), np.float32)
    out[:, PATH : PATH + WORDS] = WORD_SCALE * counts / np.maximum(np.sqrt((counts * counts).sum(1)), 1)[:, None]
    known: dict[Path, np.ndarray] = {}
    for k, (path, text, links) in enumerate(flat):
        vector = known.get(path)
        if vector is None:
            vector = np.zeros(PATH, np.float32)
            for tag, names in path:
                vector[_bucket("<" + tag, PATH)] = 1
                for name in names:
                    vector[_bucket("." + name, PATH)] = 1
            if path:
                vector[_bucket("^" + path[-1][0], PATH)] = 1
            known[path] = vector
        out[k, :PATH] = vector
        out[k, -PLAIN:] = (np.log1p(n_words[k]) / 5, links / len(text), text[-1] in ".!?:;\"')", len(path) / 10, min(1, text.count(",") / max(1, n_words[k])), 1)
    ends = np.cumsum([len(page) for page in pages])
    return [out[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Labeller:
    """A bidirectional LSTM over the blocks of a page, with a logistic output per block."""

    def __init__(self, inputs: int = PATH + WORDS + PLAIN, hidden: int = HIDDEN) -> None:
        rng = np.random.default_rng(SEED)
        self.hidden = hidden
        self.weights: dict[str, np.ndarray] = {}
        for way in ("f", "b"):
            self.weights["x" + way] = rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(inputs)
            self.weights["h" + way] = rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)
            self.weights["c" + way] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.weights["skip"] = rng.standard_normal(inputs) * 0.01
        self.weights["out"] = rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)
        self.weights["bias"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str) -> list[tuple]:
        """States of one direction over (steps, pages, inputs); masked steps keep the state."""
        n, h = x.shape[1], self.hidden
        drive = x @ self.weights["x" + way] + self.weights["c" + way]
        state, cell = np.zeros((n, h)), np.zeros((n, h))
        trace: list = [None] * len(x)
        for t in (range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)):
            gates = drive[t] + state @ self.weights["h" + way]
            sig = 1 / (1 + np.exp(-np.clip(gates[:, : 3 * h], -30, 30)))
            i, f, o, g = sig[:, :h], sig[:, h : 2 * h], sig[:, 2 * h :], np.tanh(gates[:, 3 * h :])
            new = f * cell + i * g
            squashed = np.tanh(new)
            m = mask[t][:, None]
            after, held = np.where(m, o * squashed, state), np.where(m, new, cell)
            trace[t] = (state, cell, i, f, o, g, squashed, after)
            state, cell = after, held
        return trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list, list]:
        forth, back = self._run(x, mask, "f"), self._run(x, mask, "b")
        joint = np.concatenate([np.stack([s[7] for s in forth]), np.stack([s[7] for s in back])], 2)
        return joint @ self.weights["out"] + x @ self.weights["skip"] + self.weights["bias"], forth, back

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logits, forth, back = self.logits(x, mask)
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y) * mask / mask.sum()
        h, grads = self.hidden, {}
        states = {"f": forth, "b": back}
        grads["skip"] = np.tensordot(error, x, ([0, 1], [0, 1]))
        grads["bias"] = np.array([error.sum()])
        grads["out"] = np.concatenate([
            np.tensordot(error, np.stack([s[7] for s in states[way]]), ([0, 1], [0, 1])) for way in "fb"])
        for k, way in enumerate("fb"):
            gates = np.zeros((*mask.shape, 4 * h))
            d_state, d_cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
            recurrent = np.zeros_like(self.weights["h" + way])
            for t in (range(len(x) - 1, -1, -1) if way == "f" else range(len(x))):
                state, cell, i, f, o, g, squashed, _ = states[way][t]
                m = mask[t][:, None]
                total = d_state + error[t][:, None] * self.weights["out"][k * h : (k + 1) * h]
                inner = np.where(m, total, 0)
                inside = inner * o * (1 - squashed**2) + np.where(m, d_cell, 0)
                gates[t] = np.concatenate([
                    inside * g * i * (1 - i), inside * cell * f * (1 - f), inner * squashed * o * (1 - o), inside * i * (1 - g**2)], 1)
                recurrent += state.T @ gates[t]
                d_state = np.where(m, gates[t] @ self.weights["h" + way].T, d_state)
                d_cell = np.where(m, inside * f, d_cell)
            grads["h" + way] = recurrent
            grads["x" + way] = np.tensordot(x, gates, ([0, 1], [0, 1]))
            grads["c" + way] = gates.sum((0, 1))
        return grads

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02) -> None:
        rng = np.random.default_rng(SEED + 1)
        moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            speed = rate * (1 - epoch / epochs)
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(pages[k]) // 8 for k in order], kind="stable")]
            batches = [order[k : k + 32] for k in range(0, len(order), 32)]
            for which in rng.permutation(len(batches)):
                rows = batches[which]
                x, mask = _padded([pages[k] for k in rows])
                y = np.zeros(mask.shape)
                for column, k in enumerate(rows):
                    n = len(labels[k])
                    y[:n, column] = labels[k]
                    if rng.random() < 0.7:  # words of another block: a label must not hang on them alone
                        x[:n, column, PATH : PATH + WORDS] = x[rng.permutation(n), column, PATH : PATH + WORDS]
                        x[:n, column, -PLAIN] *= rng.uniform(0.3, 1.5, n)
                step += 1
                for name, gradient in self.gradients(x, mask, y).items():
                    first, second = moments[name]
                    gradient = np.clip(gradient, -1, 1) + 1e-5 * self.weights[name]
                    first += 0.1 * (gradient - first)
                    second += 0.01 * (gradient**2 - second)
                    self.weights[name] = self.weights[name] - speed * (first / (1 - 0.9**step)) / (
                        np.sqrt(second / (1 - 0.99**step)) + 1e-8)

    def classify(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = [k for k in np.argsort([len(p) for p in pages], kind="stable") if len(pages[k])]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 128 and (end - at + 1) * len(pages[order[end]]) <= 20_000:
                end += 1
            x, mask = _padded([pages[k] for k in order[at:end]])
            logits, _, _ = self.logits(x, mask)
            for column, k in enumerate(order[at:end]):
                out[k] = logits[: len(pages[k]), column] > 0
            at = end
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]))
    mask = np.zeros((steps, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
        mask[: len(page), k] = True
    return x, mask


def furniture(path: Path) -> bool:
    return any(tag in FURNITURE_TAGS or FURNITURE_WORDS.intersection(names) for tag, names in path)


def weak_labels(page: list[Block]) -> np.ndarray:
    """What the structure of a page says: main text lies in its article, away from furniture.

    Where no element is an article, blocks with sentences and few links are taken for it.
    """
    inside = [any(tag in ARTICLE_TAGS for tag, _ in path) for path, _, _ in page]
    if not any(inside):
        inside = [len(text.split()) >= 8 and links * 3 < len(text) for _, text, links in page]
    return np.array([a and not furniture(path) for a, (path, _, _) in zip(inside, page)], float)


# Furniture of the variants, as paths inside a page, and names an article may have.
VARIANT_FURNITURE: tuple[Path, ...] = tuple(
    tuple((part.split(".")[0], tuple(part.split(".")[1:])) for part in path.split("/")) for path in (
        "aside", "aside.sidebar", "div.sidebar", "div.widget", "section.comments", "div.comments/div.comment/p", "ol.comment.list/li",
        "section.comments/article.comment/p", "div.comment", "form", "form/label", "form.search", "div.newsletter/form/p", "header", "header/h1",
        "header/p", "footer/p", "footer/ul/li", "div.cookie.notice", "div.notice/p", "div.consent", "div.alert", "div.banner", "div.promo/p",
        "div.ad", "div.advert", "div.ads/p", "section.related/ul/li", "div.related/p", "div.share", "div.social/ul/li", "nav/ol/li",
        "div.menu/ul/li", "ul.menu/li", "div.breadcrumb", "nav.breadcrumbs/ol/li", "div.popup/p", "div.subscribe/p", "button", "div.footer", "div.header",
        "div.copyright", "aside/p", "aside.related/h2", "div.pagination", "div.nav/a", "div.login/form", "div.sponsored/p", "dialog/p",
    ))
ARTICLE_NAMES: tuple[Path, ...] = (
    (("article", ()),), (("main", ()),), (("main", ()), ("article", ())), (("div", ("content",)),), (("div", ("article", "body")),),
    (("section", ("post",)),), (("div", ("entry", "content")),), (("div", ("main",)), ("section", ())),
)
ARTICLE_LEAVES = ("p", "p", "p", "p", "h1", "h2", "h3", "li", "blockquote", "pre", "td", "figcaption", "dd")


def variant(page: list[Block], labels: np.ndarray, texts: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page with another article element, other leaves in it, and furniture put in anywhere.

    The furniture's text is drawn from all texts of the sample, so words alone don't tell.
    """
    name = ARTICLE_NAMES[rng.integers(len(ARTICLE_NAMES))]
    base: Path = (("html", ()), ("body", ()))
    made: list[tuple[Block, float]] = []
    for (path, text, links), label in zip(page, labels):
        if label:
            leaf = path[-1][0] if rng.random() < 0.5 else ARTICLE_LEAVES[rng.integers(len(ARTICLE_LEAVES))]
            around = ((("ul", ()),) if leaf == "li" else (("div", ()),) if rng.random() < 0.15 else ())
            made.append(((base + name + around + ((leaf, ()),), text, links if rng.random() < 0.8 else int(len(text) * rng.random())), 1.0))
        else:
            made.append(((path, text, links), 0.0))
    for _ in range(int(rng.integers(1, 6))):
        path = VARIANT_FURNITURE[rng.integers(len(VARIANT_FURNITURE))]
        at = int(rng.integers(0, len(made) + 1))
        within = 0 < at < len(made) and made[at - 1][1] and made[at][1]
        for _ in range(int(rng.integers(1, 4))):
            text = texts[rng.integers(len(texts))]
            made.insert(at, ((base + (name if within else ()) + path, text, int(len(text) * (rng.random() < 0.3))), 0.0))
    for k, ((path, text, links), label) in enumerate(made):
        if rng.random() < 0.15:  # text of any kind: one word again and again, or words with marks
            parts = text.split(" ")
            parts = [parts[0]] * int(rng.integers(1, 60)) if rng.random() < 0.5 else [w + "%$&*#!"[rng.integers(6)] * 3 for w in parts]
            made[k] = ((path, " ".join(parts), min(links, 1)), label)
    return [b for b, _ in made], np.array([label for _, label in made])


def window(page: str) -> tuple[list[Block], np.ndarray] | None:
    """The blocks of a page and what the structure of the whole page says of them.

    Of a page longer than ``SAMPLE_CHARS`` a run of blocks of about as many characters: its
    beginning, its end or one from anywhere, by a hash of the page. None if there is no block.
    """
    found = blocks(page)
    if not found:
        return None
    labels = weak_labels(found)
    if len(page) <= SAMPLE_CHARS:
        return found, labels
    found = [(path, text[:SAMPLE_CHARS], min(links, SAMPLE_CHARS)) for path, text, links in found]
    ends = np.cumsum([len(text) + 1 for _, text, _ in found])
    draw = zlib.crc32(page.encode("utf-8", "surrogatepass"))
    spare = max(0, int(ends[-1]) - SAMPLE_CHARS)
    start = (0, spare, draw // 3 % (spare + 1))[draw % 3]
    begins = np.concatenate([[0], ends[:-1]])
    a = min(int(np.searchsorted(begins, start)), len(found) - 1)
    b = max(a + 1, int(np.searchsorted(ends, begins[a] + SAMPLE_CHARS, "right")))
    return found[a:b], labels[a:b]


def trained(pages: list[tuple[list[Block], np.ndarray]]) -> Labeller:
    """A labeller for pages like these windows."""
    rng = np.random.default_rng(SEED + 2)
    examples = list(pages) or [([((("p", ()),), "text", 0)], np.zeros(1))]  # without any block there is nothing to label
    texts = [text for page, _ in examples for _, text, _ in page]
    for page, labels in list(examples):
        examples += [variant(page, labels, texts, rng) for _ in range(3)]
    labeller = Labeller()
    labeller.train(features([p for p, _ in examples]), [label for _, label in examples])
    return labeller


def fit(pages: DataFrame) -> Labeller:
    """The labeller trained on ``SAMPLE`` pages that have text, by hash and of any length, or on all if there are fewer.

    A share of the hashes that holds about four times as many pages is ranked, so tasks
    send the driver few rows however many tasks there are; it grows while too few have text.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(order, page, found) for order, page in zip(batch.column("_order").to_pylist(), batch.column("html").to_pylist())
                    if (found := window(page))]
            yield pa.RecordBatch.from_arrays([
                pa.array([order for order, _, _ in rows], pa.int64()), pa.array([page[:SAMPLE_CHARS] for _, page, _ in rows], pa.string()),
                pa.array([hashlib.sha256(page.encode("utf-8", "surrogatepass")).digest() for _, page, _ in rows], pa.binary()),
                pa.array([pickle.dumps(found) for _, _, found in rows], pa.binary())], names=["_order", "head", "digest", "found"])

    filled = pages.filter("html is not null")
    order = F.when(F.col("page_id").isNull(), F.xxhash64("html", F.lit(SEED))).otherwise(F.xxhash64("page_id", F.lit(SEED)))
    share = min(1.0, 4 * SAMPLE / max(1, filled.count()))
    while True:
        near = filled.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).select("html", order.alias("_order"))
        sample = near.mapInArrow(cut, "_order bigint, head string, digest binary, found binary").orderBy(
            "_order", "head", "digest").limit(SAMPLE).collect()
        if len(sample) == SAMPLE or share == 1:
            break
        share = min(1.0, 8 * share)
    sample.sort(key=lambda row: (row.head, bytes(row.digest)))
    return trained([pickle.loads(row.found) for row in sample])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    ``text`` is the blocks labelled main text, in page order, one line each; empty where
    there is none. A null html is empty. Repeated rows and null ids have rows like any
    other; other columns are ignored; no rows give no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                parsed = [blocks(page or "") for page in batch.column("html").to_pylist()]
                main = shared.value.classify(features(parsed))
                texts = ["\n".join(text for (_, text, _), keep in zip(p, kept) if keep) for p, kept in zip(parsed, main)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
