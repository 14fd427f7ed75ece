"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import WORD, Memo
from panelcast.llm.html_blocks import Block, read_blocks

PATHS, WORDS, NUMBERS = 512, 48, 8
WIDTH = PATHS + WORDS + NUMBERS

#: Names of page parts, for labels of training pages.
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
FURNITURE = tuple(
    "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation navbox menu topbar toolbar breadcrumb breadcrumbs header masthead "
    "footer bottom copyright sidebar aside widget rail related recommended popular trending cookie cookies consent notice gdpr popup modal overlay alert "
    "newsletter subscribe signup login register search share sharing social comment comments commentlist respond reply discussion disqus pagination pager hidden toc tags byline".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN = tuple("article content main post entry story body text".split())


@dataclass(frozen=True)
class Training:
    """``pages``: most pages of the table that train the labeller; ``made``: generated pages beside them.

    A page gives at most ``stretch`` neighbouring blocks. Both are bounds of the driver's memory.
    """

    pages: int = 128
    made: int = 1408
    stretch: int = 48
    hidden: int = 24
    epochs: int = 14
    batch: int = 24
    rate: float = 0.01
    seed: int = 5


def _slot(kind: str, value: str, size: int) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {value}".encode()) % size


class Features:
    """Vectors of blocks: hashed tags and names on the path, hashed words, and shape of the text."""

    def __init__(self):
        self.path = Memo(self._path, 1 << 14)
        self.word = Memo(lambda w: _slot("word", w, WORDS), 1 << 18)

    @staticmethod
    def _path(path: tuple) -> np.ndarray:
        out = np.zeros(PATHS, np.float32)
        for tag, own in path:
            out[_slot("tag", tag, PATHS)] = 1
            for name in own:
                out[_slot("name", name, PATHS)] = 1
        if path:
            out[_slot("last", path[-1][0], PATHS)] = 1
        return out

    def of(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), WIDTH), np.float32)
        for row, b in zip(out, blocks, strict=True):
            row[:PATHS] = self.path[b.path]
            words = WORD.findall(b.text.lower())
            n, size = len(words), len(b.text)
            if words:
                counts = np.bincount(np.fromiter(map(self.word.__getitem__, words), np.int64, n), minlength=WORDS)
                row[PATHS : PATHS + WORDS] = counts / np.sqrt((counts * counts).sum())
            marks = sum(map(b.text.count, ".,;!?"))
            row[PATHS + WORDS :] = (np.log1p(size) / 8, np.log1p(n) / 6, b.linked / size, min(1.0, marks / (n + 1)), b.text[-1] in ".!?", b.text[0].isupper(), sum(map(str.isdigit, b.text[:200])) / min(size, 200), n < 4)
        return out


class Labeller:
    """A bidirectional LSTM with a logistic output for each block, in numpy."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p |= {f"x{way}": scale(WIDTH, 4 * hidden) * 0.5, f"h{way}": scale(hidden, 4 * hidden), f"c{way}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{way}"][hidden : 2 * hidden] = 1
        self.p |= {"o": scale(2 * hidden, 1), "s": scale(WIDTH, 1) * 0.1, "d": np.zeros(1, np.float32)}

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over (time, batch, ..); padded steps carry the state on."""
        steps, n, size = x.shape[0], x.shape[1], self.hidden
        inputs = (x.reshape(-1, WIDTH) @ self.p[f"x{way}"]).reshape(steps, n, 4 * size) + self.p[f"c{way}"]
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        out, saved = np.zeros((steps, n, size), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.p[f"h{way}"]
            gates = self._sigmoid(z[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                saved.append((t, h, c, i, f, o, g, tc))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[t] = h
        return out, saved

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(time, batch) probabilities of main text for features (time, batch, width)."""
        forward, backward = (self._run(x, mask, way, False)[0] for way in "fb")
        return self._sigmoid((np.concatenate([forward, backward], axis=2) @ self.p["o"])[:, :, 0] + (x @ self.p["s"])[:, :, 0] + self.p["d"][0])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Back-propagation through time of the mean log loss."""
        size, runs = self.hidden, {way: self._run(x, mask, way, True) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = self._sigmoid((both @ self.p["o"])[:, :, 0] + (x @ self.p["s"])[:, :, 0] + self.p["d"][0])
        d = ((p - y) * mask / mask.sum()).astype(np.float32)
        out = {"o": (both * d[:, :, None]).sum((0, 1))[:, None], "s": (x * d[:, :, None]).sum((0, 1))[:, None], "d": d.sum(keepdims=True).reshape(1)}
        for k, way in enumerate("fb"):
            top = d[:, :, None] * self.p["o"][k * size : (k + 1) * size, 0]
            dz = np.zeros((*x.shape[:2], 4 * size), np.float32)
            w = np.zeros_like(self.p[f"h{way}"])
            dh, dc = np.zeros(top.shape[1:], np.float32), np.zeros(top.shape[1:], np.float32)
            for t, h, c, i, f, o, g, tc in reversed(runs[way][1]):
                m = mask[t][:, None]
                dh = dh + top[t]
                inner = np.where(m, dc + dh * o * (1 - tc * tc), 0)
                z = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), np.where(m, dh * tc, 0) * o * (1 - o), inner * i * (1 - g * g)], axis=1)
                dz[t] = z
                w += h.T @ z
                dh = np.where(m, z @ self.p[f"h{way}"].T, dh)
                dc = np.where(m, inner * f, dc)
            out[f"x{way}"] = x.reshape(-1, WIDTH).T @ dz.reshape(-1, 4 * size)
            out[f"h{way}"], out[f"c{way}"] = w, dz.sum((0, 1))
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], settings: Training, rng: np.random.Generator) -> None:
        """Adam over shuffled batches of (features, labels)."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, settings.epochs * -(-len(pages) // settings.batch)
        for _ in range(settings.epochs):
            order = rng.permutation(len(pages))
            for i in range(0, len(order), settings.batch):
                x, mask = padded([pages[k][0] for k in order[i : i + settings.batch]])
                y = np.zeros(mask.shape, np.float32)
                for column, k in enumerate(order[i : i + settings.batch]):
                    y[: len(pages[k][1]), column] = pages[k][1]
                step += 1
                rate = settings.rate * (1 - step / (total + 1))
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), WIDTH), np.float32), np.zeros((longest, len(pages)), bool)
    for i, f in enumerate(pages):
        x[: len(f), i], mask[: len(f), i] = f, True
    return x, mask


def marked(blocks: list[Block]) -> list[int] | None:
    """Training labels from markup: main text is what stands in a main part and in no furniture; None for a page without a main part."""
    furniture = [any(t in FURNITURE_TAGS or not {*FURNITURE}.isdisjoint(n) for t, n in b.path) for b in blocks]
    inside = [any(t in MAIN_TAGS or "main" in n for t, n in b.path) for b in blocks]
    if not any(i and not f for i, f in zip(inside, furniture, strict=True)):
        return None
    return [int(i and not f) for i, f in zip(inside, furniture, strict=True)]


_SYLLABLES = "an be co da el fi go ha in jo ka lu me no or pa qui re st tion um ver wa ex yo zu er th ou".split()


def made_page(rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A generated page: main text of one of several layouts among furniture, with labels by construction."""
    html, marks = [], []

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES, rng.integers(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.integers(low, high)))

    def sentence() -> str:
        end = rng.choice([".", ".", "!", "?", "", ".</b>"])
        noise = rng.choice(["", "", "", "***", "%%%", "!!", " |"])
        return (" ".join(word() + noise for _ in range(rng.integers(1, 24))).capitalize() + end).replace("</b>", "")

    def put(text: str, main: int) -> str:
        marks.append(main)
        return text

    def named(tag: str, choices) -> str:
        name = str(rng.choice(choices))
        key = rng.choice(["class", "id"])
        extra = rng.choice(["", "-box", " x1", "-wrap", "__inner"])
        return f'<{tag} {key}="{name}{extra}">'

    def furniture() -> str:
        kind = rng.choice([0, 1, 1, 2, 3, 4, 5])
        if kind == 0:
            tag = str(rng.choice(["nav", "ul", "div"]))
            start = "<nav>" if tag == "nav" else named(tag, ["menu", "navbar", "breadcrumb", "nav", "toolbar"])
            return start + "<ul>" + "".join(f'<li><a href="/x">{put(words(1, 4), 0)}</a></li>' for _ in range(rng.integers(1, 9))) + f"</ul></{tag}>"
        if kind == 1:
            tag = str(rng.choice(["footer", "header", "aside", "form", "menu", "dialog"]))
            return f"<{tag}>" + "".join(f"<{t}>{put(sentence(), 0)}</{t}>" for t in rng.choice(["p", "div", "li", "h2", "h3", "label"], rng.integers(1, 4)) if t != "label") + put(words(1, 9), 0) + f"</{tag}>"
        if kind in (2, 3):
            start = named(str("div"), FURNITURE)
            return start + "".join(f"<p>{put(sentence() + ' ' + sentence(), 0)}</p>" for _ in range(rng.integers(0, 5))) + put(sentence(), 0) + "</div>"
        if kind == 4:
            tag = str(rng.choice(["section", "div", "ol"]))
            start = named(tag, ["comments", "comment", "respond", "discussion", "commentlist"])
            if rng.random() < 0.4:
                return start + "".join(f"<p>{put(sentence() + ' ' + sentence(), 0)}</p>" for _ in range(rng.integers(1, 5))) + f"</{tag}>"
            return start + f"<h3>{put(words(1, 4), 0)}</h3>" + "".join(f'<div class="comment"><p>{put(words(1, 3), 0)}</p><p>{put(sentence() + " " + sentence(), 0)}</p></div>' for _ in range(rng.integers(1, 6))) + f"</{tag}>"
        return f'<div class="{rng.choice(["ad", "ads", "sponsored", "promo", "banner", "cookie-notice", "popup", "share"])}">{put(sentence(), 0)}</div>'

    def text() -> str:
        tag = str(rng.choice(["p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "td", "div"]))
        body = put(" ".join(sentence() for _ in range(rng.integers(1, 5))), 1)
        if tag == "li":
            return f"<ul><li>{body}</li></ul>"
        if tag == "td":
            return f"<table><tr><td>{body}</td></tr></table>"
        if tag == "p" and rng.random() < 0.15:
            return f"<p><b>{body}<br>"
        return f"<{tag}>{body}</{tag}>"

    html += [furniture() for _ in range(rng.integers(0, 4))]
    layout = rng.integers(0, 4)
    tag = str(rng.choice(["article", "main"])) if layout < 2 else str(rng.choice(["div", "section"]))
    html.append(f"<{tag}>" if layout < 2 else (named(tag, MAIN) if layout == 2 else f"<{tag}>"))
    if rng.random() < 0.8:
        html.append(f"<h1>{put(words(1, 12), 1)}</h1>")
    for _ in range(rng.integers(1, 14)):
        html.append(text())
        if rng.random() < 0.25:
            html.append(furniture())
    html.append(f"</{tag}>")
    html += [furniture() for _ in range(rng.integers(0, 4))]
    blocks = read_blocks("<html><body>" + "".join(html) + ("</body></html>" if rng.random() < 0.8 else ""))
    return blocks, marks


def train(pages: DataFrame, settings: Training = Training(), id_column: str = "page_id", html_column: str = "html") -> Labeller:
    """Fits the labeller to generated pages and to a bounded sample of ``pages`` labelled by their markup.

    The sample is the pages with the smallest hashes of the id; a stretch of blocks of each is read into
    features where the page is.
    """
    rng = np.random.default_rng(settings.seed)
    source = pages.select(F.xxhash64(id_column).alias("h"), F.col(html_column).alias("html")).where("html is not null")
    picked = source.orderBy("h").limit(settings.pages)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for frame in frames:
            x, y = [], []
            for h, page in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                blocks = read_blocks(page)
                labels = marked(blocks)
                if labels:
                    start = h % max(1, len(blocks) - settings.stretch + 1)
                    x.append(features.of(blocks[start : start + settings.stretch]).ravel())
                    y.append(labels[start : start + settings.stretch])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), pa.array(y, pa.list_(pa.int32()))], names=["x", "y"])

    rows = picked.mapInArrow(run, "x array<float>, y array<int>").toPandas() if settings.pages else None
    sample = [] if rows is None else sorted(((np.array(x, np.float32).reshape(-1, WIDTH), np.array(y, np.float32)) for x, y in zip(rows.x, rows.y, strict=True)), key=lambda r: (len(r[1]), r[0].tobytes()))
    features = Features()
    for _ in range(settings.made):
        blocks, labels = made_page(rng)
        if len(blocks) == len(labels) and blocks:
            sample.append((features.of(blocks), np.array(labels, np.float32)))
    labeller = Labeller(settings.hidden, rng)
    labeller.fit(sample, settings, rng)
    return labeller


class Extractor:
    """Main text of pages by a trained labeller; pages of similar length are labelled together."""

    def __init__(self, labeller: Labeller, together: int = 64, most: int = 1 << 15):
        self.labeller, self.together, self.most = labeller, together, most
        self.features = Features()

    def texts(self, pages: list[str | None]) -> list[str]:
        blocks = [read_blocks(p) for p in pages]
        order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
        out, group = [""] * len(pages), []
        for at, i in enumerate(order):
            group.append(i)
            longest = len(blocks[order[at + 1]]) if at + 1 < len(order) else 0
            if not longest or len(group) == self.together or longest * (len(group) + 1) > self.most:
                x, mask = padded([self.features.of(blocks[k]) for k in group])
                main = self.labeller.probabilities(x, mask) > 0.5
                for column, k in enumerate(group):
                    out[k] = "\n\n".join(b.text for b, keep in zip(blocks[k], main[:, column], strict=False) if keep)
                group = []
        return out


def extract(pages: DataFrame, labeller: Labeller, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per input row: id, url, main text and its code points.

    A block is text between elements that are not inside a line; references are decoded and white space is one
    space. Every block of the whole page is labelled in the context of all others; blocks of main text are
    joined by two line feeds. A null or empty page, and one without main text, gives an empty text. Repeated
    rows give repeated results; a null id or url stays null; other columns are not read.
    """
    kind, url = pages.schema[id_column].dataType.simpleString(), pages.schema[url_column].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(labeller)
        for frame in frames:
            for start in range(0, frame.num_rows, 512):
                part = frame.slice(start, 512)
                texts = extractor.texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_column, url_column, "text", "n_chars"])

    return pages.select(id_column, url_column, html_column).mapInArrow(run, f"`{id_column}` {kind}, `{url_column}` {url}, text string, n_chars long")
