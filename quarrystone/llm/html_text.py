"""Main text of web pages by a recurrent block labeller.

A page is cut into text blocks. Each block is read as a vector: the hashed tags and class
words above it, its hashed words, and a few measures of its text. A bidirectional LSTM in
numpy runs over the page's blocks, so that every block is labelled with the whole page in
view, and those labelled main text are joined by line feeds.

The labeller is trained here, on pages made by rules from page parts whose labels are known:
articles of headings, paragraphs, lists, tables and quotations, and around them menus,
headers, footers, sidebars, notices, adverts, forms and reader comments, under varied tags,
class names and nesting. Nothing is learnt from the pages that are extracted.

* A null html counts as empty. Scripts, styles, comments in markup and the head give no
  blocks. Character references are decoded, white space within a block becomes one space, and
  nothing else is dropped or cut. Pages without main text get an empty text.
* Rows are independent: repeated rows are repeated, and an empty table gives no rows. Columns
  other than page_id, url and html are not read.
"""

from __future__ import annotations

import functools
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import sliced
from quarrystone.llm.html_blocks import Block, blocks

PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 256, 64, 8, 24
PAGES_TRAINED, EPOCHS, TOGETHER = 1400, 9, 64
#: Blocks of one batch, padding included; a page with more is a batch of its own.
CELLS = 1 << 15


@functools.lru_cache(100_000)
def slot(kind: str, token: str) -> int:
    return zlib.crc32(f"{kind}:{token}".encode()) % (PATH_DIMS if kind == "p" else WORD_DIMS)


@functools.lru_cache(20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_DIMS, np.float32)
    for place, step in enumerate(path):
        for k, token in enumerate(step.split(".")):
            out[slot("p", token if k == 0 else f".{token}")] += 1.0
        if place == len(path) - 1:
            out[slot("p", f"last {step.split('.')[0]}")] += 1.0
    return np.minimum(out, 2.0)


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), PATH_DIMS + WORD_DIMS + MEASURES), np.float32)
    for i, b in enumerate(page):
        out[i, :PATH_DIMS] = path_vector(b.path)
        words = b.text.lower().split()
        counts = np.bincount([slot("w", w) for w in words], minlength=WORD_DIMS)
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt(len(words))
        n = len(b.text)
        out[i, PATH_DIMS + WORD_DIMS :] = (np.log1p(n) / 5, b.linked / n, min(1.0, len(words) / 40), float(b.text[-1] in ".!?…\"»”"), b.text.count(",") / len(words), i / len(page), float("©" in b.text), 1.0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output for each block."""

    def __init__(self, seed: int = 17):
        r = np.random.default_rng(seed)
        d = PATH_DIMS + WORD_DIMS + MEASURES
        self.w: dict[str, np.ndarray] = {"out": r.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in "fb":
            self.w[f"x{side}"] = r.normal(0, d**-0.5, (d, 4 * HIDDEN))
            self.w[f"h{side}"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (pages, blocks, HIDDEN). Blocks beyond a page's end leave its state as it is."""
        n, t, _ = x.shape
        gates = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, t, HIDDEN), np.float32)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = gates[:, k] + h @ self.w[f"h{side}"]
            i, f, o = (sigmoid(z[:, a * HIDDEN : (a + 1) * HIDDEN]) for a in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c_new)
            h_new = m * (o * tc) + (1 - m) * h
            if keep is not None:
                keep.append((k, h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            out[:, k] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return sigmoid(np.concatenate([self.run(x, mask, "f"), self.run(x, mask, "b")], axis=2) @ self.w["out"] + self.w["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run(x, mask, s, kept[s]) for s in "fb"], axis=2)
        dz = (sigmoid(states @ self.w["out"] + self.w["bias"]) - y) * mask / mask.sum()
        grads = {"out": np.einsum("nt,nth->h", dz, states), "bias": np.array([dz.sum()], np.float32)}
        for at, side in enumerate("fb"):
            into = dz[:, :, None] * self.w["out"][at * HIDDEN : (at + 1) * HIDDEN]
            dgates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dwh = np.zeros_like(self.w[f"h{side}"])
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for k, h, c, i, f, o, g, tc, m in reversed(kept[side]):
                dh = dh + into[:, k]
                own_c = dc + m * dh * o * (1 - tc * tc)
                d = m * np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), dh * tc * o * (1 - o), own_c * i * (1 - g * g)], axis=1)
                dgates[:, k] = d
                dwh += h.T @ d
                dh = d @ self.w[f"h{side}"].T + (1 - m) * dh
                dc = m * own_c * f + (1 - m) * dc
            grads |= {f"x{side}": np.einsum("ntd,ntg->dg", x, dgates, optimize=True), f"h{side}": dwh, f"c{side}": dgates.sum((0, 1))}
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01) -> None:
        order = np.random.default_rng(23)
        first, second, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        by_length = sorted(pages, key=lambda p: len(p[0]))
        batches = [by_length[i : i + 32] for i in range(0, len(pages), 32)]
        for epoch in range(epochs):
            for b in order.permutation(len(batches)):
                x, mask = padded([p[0] for p in batches[b]])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(batches[b]):
                    y[k, : len(labels)] = labels
                # words and class names that training has not met must not sway a label
                x[:, :, : PATH_DIMS + WORD_DIMS] *= order.random((len(x), 1, PATH_DIMS + WORD_DIMS)) > 0.1
                step += 1
                grads = self.gradients(x, mask, y)
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                now = rate * (0.3 if epoch >= epochs - 3 else 1.0)
                for k, g in grads.items():
                    g = g * min(1.0, 5 / max(size, 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # pages come in order of their blocks: the last of a batch is its longest, to which all are padded
            to = at + 1
            while to < min(len(order), at + TOGETHER) and (to + 1 - at) * len(pages[order[to]]) <= CELLS:
                to += 1
            rows, at = order[at:to], to
            x, mask = padded([vectors(pages[i]) for i in rows])
            for i, s in zip(rows, self.scores(x, mask), strict=True):
                out[i] = s[: len(pages[i])] >= 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((len(pages), t, PATH_DIMS + WORD_DIMS + MEASURES), np.float32), np.zeros((len(pages), t), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


# Made pages. Main text is marked by a character that no text holds, and the mark is taken off
# again when the blocks are read.
MARK = "\ue000"
SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve ung ich sch ein zu que la tion ez cion os mente pa eau oi".split()
BOILERPLATE = (
    "home about contact menu search login sign subscribe newsletter email privacy policy terms cookies accept all rights reserved copyright share tweet follow us comments reply "
    "posted by ago related articles read more next previous advertisement sponsored archive categories tags kontakt impressum datenschutz anmelden suche kommentare mehr "
    "accueil mentions connexion recherche commentaires inicio contacto buscar comentarios aviso legal we use this site your name submit send"
).split()
OUTER = {
    "menu": (["nav", "div.nav", "div.menu", "ul.navbar", "div.navigation", "nav.breadcrumb", "div.breadcrumbs", "div.topbar", "div.pagination", "menu"], "links"),
    "header": (["header", "div.header", "div.masthead", "header.site", "div.branding", "div.hero.banner"], "short"),
    "footer": (["footer", "div.footer", "div.copyright", "footer.site", "div.bottom", "section.footer"], "short"),
    "sidebar": (["aside", "div.sidebar", "aside.widget", "div.side", "div.related", "section.related", "div.recommended", "div.popular", "div.widget"], "mixed"),
    "notice": (["div.cookie", "div.notice", "div.consent", "div.alert", "div.banner", "div.popup.modal", "div.gdpr", "p.notice", "dialog", "div.message.warning"], "prose"),
    "advert": (["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "aside.ad", "div.promo", "section.sponsor", "ins.ads", "div.banner.ad"], "prose"),
    "form": (["form", "form.search", "form.login", "div.subscribe", "div.newsletter", "form.signup", "fieldset"], "form"),
    "comments": (["div.comments", "section.comments", "ol.comment.list", "div.discussion", "div.responses", "section.comments", "ul.comments", "div.reader.comments", "div.replies"], "comments"),
    "share": (["div.share", "div.social", "ul.tags", "div.meta", "div.byline.meta"], "links"),
}
INNER = ["article", "div.content", "main", "div.post", "div.entry.content", "div.article.body", "section", "div.story", "div.text", "div", "article.post", "main.main", "section.article", "td", "div.main.content", "div.page"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int, boiler: float = 0.0) -> str:
        return " ".join(self.r.choice(BOILERPLATE) if self.r.random() < boiler else "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n))

    def odd(self) -> str:
        """Main text that doesn't look like prose: rows of cells, shouting, decorated or repeated words, numbers."""
        r, n = self.r, self.r.randint(3, 80)
        words = self.words(n).split()
        sign = r.choice(["***", "$$$", "%%%", "&&&", "###", "!!", "=", "~"])
        return r.choice([
            lambda: " | ".join(words),
            lambda: " ".join(w + sign for w in words),
            lambda: " ".join(w.upper() + sign for w in words),
            lambda: " ".join([words[0]] * n),
            lambda: " ".join(r.choice([w, str(r.randint(1, 10**9)), f"{w}.{r.randint(1, 99)}@mail.{w}.com"]) for w in words),
            lambda: "; ".join(f"{w} = {r.random()}" for w in words),
        ])()

    def prose(self, least: int = 1, most: int = 60, boiler: float = 0.0) -> str:
        out, left = [], self.r.randint(least, most)
        while left > 0:
            n = min(left, self.r.randint(2, 16))
            out.append(self.words(n, boiler).capitalize() + self.r.choice([".", ".", ".", "!", "?", ","]))
            left -= n
        return " ".join(out)

    def tagged(self, spec: str, inside: str, closed: bool = True) -> str:
        tag, *names = spec.split(".")
        own = ""
        if names:
            key = self.r.choice(["class", "class", "id"])
            own = f' {key}="{self.r.choice(["-", " ", "_"]).join(names)}"'
        elif self.r.random() < 0.15:
            own = f' class="{self.words(1)}"'
        return f"<{tag}{own}>{inside}" + (f"</{tag}>" if closed else "")

    def link(self, text: str) -> str:
        return f'<a href="/{self.words(1)}">{text}</a>'

    def links(self) -> str:
        items = [self.link(self.words(self.r.randint(1, 3), 0.4)) for _ in range(self.r.randint(2, 8))]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{i}</div>" for i in items), lambda: "".join(f"<li>{i}" for i in items)])()

    def beside(self, kind: str) -> str:
        specs, what = OUTER[kind]
        r = self.r
        if what == "links":
            inside = self.links()
        elif what == "short":
            inside = "".join(r.choice([f"<p>{self.words(r.randint(1, 8), 0.4)}</p>", f"<div>{self.words(r.randint(1, 6), 0.3)}</div>", f"&copy; {self.words(2)} &middot; {self.prose(1, 20)}", self.links(), f"<h1>{self.words(3)}</h1>" if kind == "header" else self.prose(1, 30)]) for _ in range(r.randint(1, 3)))
        elif what == "mixed":
            inside = f"<h3>{self.words(2, 0.5)}</h3>" * r.randint(0, 1) + "".join(r.choice([self.links(), f"<p>{self.prose(2, 30, 0.1)}</p>", f"<div><h4>{self.link(self.words(5))}</h4><p>{self.prose(3, 20)}</p></div>"]) for _ in range(r.randint(1, 4)))
        elif what == "prose":
            inside = r.choice([self.prose(1, 30, 0.1), f"<p>{self.prose(1, 40, 0.2)}</p>", f"<p>{self.prose(2, 15, 0.5)}</p><button>{self.words(1, 1)}</button>", f"<span>{self.words(2, 0.7)}</span> {self.link(self.words(3))}", f"<div><p>{self.prose(3, 30)}</p><p>{self.prose(3, 30)}</p></div>"])
        elif what == "form":
            inside = "".join(r.choice([f'<label>{self.words(1, 0.9)}</label><input name="q">', f"<button>{self.words(1, 0.9)}</button>", f"<select><option>{self.words(1)}<option>{self.words(1)}</select>", f"<p>{self.prose(2, 20, 0.4)}</p>", f"<textarea>{self.words(4, 0.4)}</textarea>"]) for _ in range(r.randint(1, 5)))
        else:
            one = lambda: r.choice([f'<div class="comment"><b>{self.words(2)}</b> <p>{self.prose(2, 60)}</p></div>', f'<li class="comment"><p>{self.prose(2, 60)}</p><a href="#">{self.words(1, 1)}</a></li>', f'<article class="comment"><header>{self.words(2)}</header><p>{self.prose(3, 50)}</p></article>', f"<p>{self.prose(2, 50)}</p>", f'<div class="reply"><span>{self.words(1)}</span><div>{self.prose(2, 40)}</div></div>'])
            inside = f"<h2>{self.words(2, 0.8)}</h2>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6)))
        if r.random() < 0.25:
            inside = self.tagged("div", inside)
        return self.tagged(r.choice(specs), inside)

    def article(self) -> str:
        r, m, out = self.r, MARK, []
        if r.random() < 0.8:
            out.append(f"<h1>{m}{self.words(r.randint(2, 12))}</h1>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.62:
                text = self.prose(1, r.choice([4, 30, 120])) if r.random() < 0.75 else self.odd()
                if r.random() < 0.15:
                    text = f"{text} {self.link(self.words(2))} {self.prose(1, 20)}"
                lead = r.choice(["", "", "", "<b>", "<b>"])
                out.append(f"<p>{lead}{m}{text}" + r.choice(["</p>", "</p>", "</p>", "<br>", ""]))
            elif kind < 0.72:
                out.append(f"<h{(n := r.randint(2, 4))}>{m}{self.words(r.randint(1, 8))}</h{n}>")
            elif kind < 0.8:
                out.append("<ul>" + "".join(f"<li>{m}{self.prose(1, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.85:
                out.append(f"<blockquote><p>{m}{self.prose(3, 40)}</p></blockquote>")
            elif kind < 0.89:
                out.append(f"<pre>{m}{self.words(r.randint(3, 20))}</pre>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.words(2)}</td><td>{m}{self.words(3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                out.append(f"<div>{m}{self.prose(5, 60)}</div>")
            else:
                out.append(self.beside(r.choice(["advert", "share", "advert", "form", "sidebar"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        before = [self.beside(k) for k in r.sample(["menu", "header", "notice", "advert", "form", "sidebar", "menu"], r.randint(0, 4))]
        after = [self.beside(k) for k in r.sample(["share", "comments", "comments", "sidebar", "advert", "form", "notice", "footer", "menu"], r.randint(0, 4))]
        body = self.article() if r.random() < 0.97 else ""
        inner = r.choice(INNER)
        if r.random() < 0.2:  # comments and the like within what holds the article
            body += self.beside(r.choice(["comments", "share", "form", "advert", "sidebar"]))
        main = self.tagged(inner, body) if r.random() < 0.93 else body
        if r.random() < 0.4:
            main = self.tagged(r.choice(["div.wrapper", "div.container", "main", "div", "div.row"]), main)
        whole = "".join(before) + main + "".join(after) + (f"<footer>&copy; {self.prose(1, 20)}</footer>" if r.random() < 0.5 else "")
        if r.random() < 0.3:
            whole = self.tagged(r.choice(["div.wrapper", "div.page", "div", "div.site"]), whole)
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title></head><body>{whole}</body></html>"


def made(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    maker, out = Maker(seed), []
    while len(out) < n:
        page = blocks(maker.page())
        if page:
            labels = np.array([MARK in b.text for b in page], np.float32)
            out.append((vectors([b._replace(text=b.text.replace(MARK, "").strip() or "x") for b in page]), labels))
    return out


@functools.lru_cache(1)
def trained() -> Labeller:
    model = Labeller()
    model.fit(made(PAGES_TRAINED, 29))
    return model


TEXT = "page_id long, url string, text string, n_chars long"
#: Bytes of pages that are cut into blocks at a time.
PAGE_BYTES = 8 << 20


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2, PAGE_BYTES):
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                cut = [blocks(h or "") for h in part.column(2).to_pylist()]
                texts = ["\n".join(x.text for x, main in zip(page, labels, strict=True) if main) for page, labels in zip(cut, shared.value.label(cut), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(of, TEXT)
