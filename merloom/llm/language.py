"""Languages of documents and of their mixed-language segments, with confidence.

A text is lower-cased and composed (NFC), interruptions in brackets or between
dashes are set aside, and the rest is cut into sentences. The network labels
every position (a step of ``BLOCK`` bytes at a time) from its neighbourhood on
both sides. Runs of positions with one label are the units of a Viterbi pass
over the document, with a cost for changing the language that is lower between
sentences than inside one; what it leaves are the labels of the positions, and
their runs are the segments, which may begin inside a sentence. A sentence is
in the language of most of its positions. A text holds a language that
``MIN_RUN`` or more sentences in a row are in, or, where there is none such, the language
of most positions.

Training: the labelled samples (at most ``PER_LANGUAGE_SAMPLES`` a language), then
also at most ``PER_LANGUAGE`` short documents for each delivered language, last
without those whose label the network still rejects. The trained network (a
few hundred kB) is stored in the shared folder under a hash of all it was
trained with, so queries over the same tables train once; it is broadcast.

Cases: null or blank text holds no language and gives no row, nor does a text
without any letter; a text of interruptions only is labelled by them; ties go
to the label that sorts first; very long sentences are read in windows of
``MAX_BYTES``.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merloom.llm.gru import BLOCK, ByteGRU, pairs_of, to_blocks
from merloom.session import exists, shared_folder, small

VERSION = 2  # of the way of training: part of the name of a stored network
MIN_RUN = 3
PER_LANGUAGE = 300
PER_LANGUAGE_SAMPLES = 2000
MAX_BYTES = 512
SWITCH = 2.5  # cost of a change of language between sentences, in nats
INSIDE = 8.0  # and inside a sentence
FLOOR = 4.0  # a step counts at most this much against a language
# Fixed value: abbreviations before names that end no sentence.
_TITLES = frozenset("dr prof mr mrs ms mme mlle sr sra srta dra hr fr dhr mevr drs".split())
_SHORT_DOT = "|".join([r"(?<=\b\w)\.", *(rf"(?<=\b{t})\." for t in sorted(_TITLES))])  # of an initial or a title
_ASIDE = re.compile(rf"\([^()\n]*\)|\[[^\[\]\n]*\]|(?<!\S)[–—](?=\s)(?:[^–—.!?\n]|{_SHORT_DOT}|[.!?]+(?=\s*[–—]))*(?<=\s)[–—](?!\S)")
_OPENS = re.compile(r"[(\[–—]")
_END = re.compile(r"[.!?…]+[\"'»”’]*(?=\s|$)")
_LAST = re.compile(r"[^\W\d_]+$")
_LETTER = re.compile(r"[^\W\d_]")


def plain(text: str) -> str:
    t = text.lower()
    return t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a plain text; interruptions belong to none. Whole-interruption texts are one span."""
    spans: list[tuple[int, int]] = []
    masked = _ASIDE.sub(lambda m: " " * len(m.group()), text) if _OPENS.search(text) else text
    if not masked.strip():
        masked = text
    at = 0
    for m in _END.finditer(masked):
        i = m.start()
        if masked[i] == "." and m.end() == i + 1 and not (i >= at + 5 and masked[i - 5 : i].isalpha()):
            word = _LAST.search(masked, max(at, i - 5), i)
            if word and (len(word.group()) == 1 or word.group() in _TITLES):
                continue  # an initial or a title before a name
        spans.append((at, m.end()))
        at = m.end()
    if masked[at:].strip():
        spans.append((at, len(masked)))
    out = []
    for s, e in spans:
        if not _LETTER.search(masked, s, e):  # what has no letter is in no language
            continue
        body = masked[s:e]
        lean = body.lstrip()
        s += len(body) - len(lean)
        out.append((s, s + len(lean.rstrip())))
    return out


def _bytes(text: str) -> bytes:
    return text.replace("\n", " ").replace("\r", " ").replace("\t", " ").encode("utf-8", "replace")


def windows(sentence: bytes) -> list[bytes]:
    if len(sentence) <= MAX_BYTES:
        return [sentence or b" "]
    return [sentence[i : i + MAX_BYTES] for i in range(0, len(sentence), MAX_BYTES)]


def _damage(t: str, r: np.random.Generator) -> str:
    """Training noise: stripped accents, misread letters, changed phase."""
    kind = r.integers(0, 6)
    if kind == 0:
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    elif kind == 1:
        swap = {"l": "1", "o": "0", "h": "b", "e": "c", "i": "l", "u": "n"}
        t = "".join(swap.get(c, c) if r.random() < 0.15 else c for c in t)
    words = t.split(" ")
    if len(words) > 3:
        k = int(r.integers(2, len(words) + 1))
        a = int(r.integers(0, len(words) - k + 1))
        t = " ".join(words[a : a + k]) if r.random() < 0.6 else t
        if r.random() < 0.25:
            w = t.split(" ")
            r.shuffle(w)
            t = " ".join(w)
    return " " * int(r.integers(0, BLOCK)) + t


def _batches(texts: list[str], y: np.ndarray, epochs: int, size: int, r: np.random.Generator):
    total, done = epochs * (-(-len(texts) // size)), 0
    for _ in range(epochs):
        noisy = [_bytes(_damage(t, r)) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: (len(noisy[i]) // 16, r.random()))
        chunks = [order[i : i + size] for i in range(0, len(order), size)]
        for k in r.permutation(len(chunks)):
            x, steps = to_blocks([noisy[i] for i in chunks[k]])
            yield x, steps, y[chunks[k]], done / total
            done += 1


def train(samples: list[tuple[str, str]], extra: list[tuple[str, str]] = (), hidden: int = 24, epochs: int = 40, seed: int = 7) -> ByteGRU:
    """A network from (language, text) samples; ``extra`` texts are used where the network trained so far agrees with their label."""
    labels = sorted({g for g, _ in samples})
    r = np.random.default_rng(seed)

    def cut(rows):
        texts, y = [], []
        for g, t in rows:
            p = plain(t)
            for s, e in sentences(p):
                for at in range(s, e, MAX_BYTES):
                    texts.append(p[at : min(e, at + MAX_BYTES)])
                    y.append(labels.index(g))
        return texts, np.array(y, np.int64)

    texts, y = cut(samples)
    net = ByteGRU(labels, hidden, seed, pairs_of([_bytes(t) for t in texts]))
    net.train(_batches(texts, y, epochs, 64, r))
    extra = [(g, t) for g, t in extra if g in labels]
    if extra:
        more, z = cut(extra)
        keep = np.arange(len(more))
        for _ in range(2):  # with all of them, then without those whose label the network still rejects
            net.train(_batches(texts + [more[i] for i in keep], np.concatenate([y, z[keep]]), max(1, epochs // 3), 64, r), rate=0.004)
            keep = np.flatnonzero(net.logits([_bytes(t) for t in more]).argmax(1) == z)
    return net


def _viterbi(score: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Best path of labels, one for each unit; ``cost[i]`` is that of a change before unit i."""
    n, k = score.shape
    best = score[0].copy()
    back = np.zeros((n, k), np.int64)
    own = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] - cost[i]
        stay = best >= jump
        back[i] = np.where(stay, own, top)
        best = np.where(stay, best, jump) + score[i]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _logp(logit: np.ndarray) -> np.ndarray:
    shifted = logit - logit.max(1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(1, keepdims=True))


def _shares(total: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Probabilities of the labels from byte-weighted sums of log-probabilities."""
    mean = total / n_bytes[:, None]
    prob = np.exp(mean - mean.max(1, keepdims=True))
    return prob / prob.sum(1, keepdims=True)


def held(labels: list[int], n_bytes: np.ndarray) -> list[int]:
    """Languages of the runs of MIN_RUN sentences or more; without any, the one of most bytes."""
    found, run = set(), 0
    for i, g in enumerate(labels):
        run = run + 1 if i and labels[i - 1] == g else 1
        if run >= MIN_RUN:
            found.add(g)
    return sorted(found) or [int(n_bytes.argmax())]


_SEGMENT = "struct<start int, end int, lang string, confidence double, n_sentences int, n_bytes int>"
SCHEMA = f"id long, label string, langs array<string>, confidence double, segments array<{_SEGMENT}>"
_ARROW = pa.schema(
    [
        ("id", pa.int64()), ("label", pa.string()), ("langs", pa.list_(pa.string())), ("confidence", pa.float64()),
        ("segments", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32()), ("n_bytes", pa.int32())]))),
    ]
)


def label_texts(net: ByteGRU, texts: list[str | None], switch: float = SWITCH, inside: float = INSIDE) -> list[tuple[list[str], list[dict]] | None]:
    """Languages and segments of each text; None for blank ones."""
    plains, spans_of, first, parts, owner = [], [], [], [], []
    for t in texts:
        p = plain(t) if t else ""
        plains.append(p)
        first.append(len(spans_of))
        for s, e in sentences(p) if p.strip() else []:
            for w in windows(_bytes(p[s:e])):
                parts.append(w)
                owner.append(len(spans_of))
            spans_of.append((s, e))
    first.append(len(spans_of))
    if not parts:
        return [None] * len(texts)
    logit, steps = net.block_logits(parts)
    # positions: the sentence and the bytes of each step
    last = np.cumsum(steps) - 1
    size = np.full(len(logit), BLOCK, np.float32)
    size[last] = np.array([len(w) for w in parts]) - BLOCK * (steps - 1)
    sent = np.repeat(np.array(owner), steps)
    logp = _logp(logit)
    label = logp.argmax(1)
    # units: runs of positions of one label in a sentence
    fresh = np.r_[True, sent[1:] != sent[:-1]]
    at = np.flatnonzero(fresh | np.r_[True, label[1:] != label[:-1]])
    score = np.add.reduceat(np.maximum(logp, -FLOOR) * (size / BLOCK)[:, None], at, axis=0)
    weighed = np.add.reduceat(logp * size[:, None], at, axis=0)
    byte_at = np.cumsum(size) - size
    n_bytes, unit_sent, unit_label, unit_fresh = np.add.reduceat(size, at), sent[at], label[at], fresh[at]
    cost = np.where(unit_fresh, switch, inside)
    of = np.searchsorted(unit_sent, first)
    sent_byte = byte_at[fresh.nonzero()[0]]  # where each sentence begins
    unit_byte = byte_at[at] - sent_byte[unit_sent]
    turns = np.concatenate([[0], np.cumsum(unit_label[1:] != unit_label[:-1])])
    k = len(net.labels)
    filled = [i for i in range(len(texts)) if of[i] < of[i + 1]]
    whole = dict(zip(filled, zip(_shares(np.add.reduceat(weighed, of[filled], axis=0, dtype=np.float64), w := np.add.reduceat(n_bytes, of[filled], dtype=np.float64)), w.tolist())))

    def place(doc: int, u: int) -> int:
        """Offset of the first character of a unit."""
        s, e = spans_of[unit_sent[u]]
        return s if unit_fresh[u] else s + len(_bytes(plains[doc][s:e])[: int(unit_byte[u])].decode("utf-8", "ignore"))

    out: list = []
    for i in range(len(texts)):
        a, b = int(of[i]), int(of[i + 1])
        if a == b:
            out.append(None)
            continue
        if turns[a] == turns[b - 1]:  # one label everywhere: nothing to search
            g, (share, w) = int(unit_label[a]), whole[i]
            lo, hi = first[i], first[i + 1]
            out.append(([net.labels[g]], [{"start": spans_of[lo][0], "end": spans_of[hi - 1][1], "lang": net.labels[g], "confidence": float(share[g]), "n_sentences": hi - lo, "n_bytes": int(w)}]))
            continue
        path = _viterbi(score[a:b], cost[a:b])
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(path))).tolist(), b]
        total = np.zeros((first[i + 1] - first[i], k))
        np.add.at(total, (unit_sent[a:b] - first[i], path), n_bytes[a:b])
        have = held(total.argmax(1).tolist(), total.sum(0))
        segments = []
        for x, y in zip(cuts, cuts[1:]):
            g, w = int(path[x - a]), n_bytes[x:y].sum(dtype=np.float64)
            share = _shares(weighed[x:y].sum(0, keepdims=True, dtype=np.float64), np.array([w]))[0]
            end = spans_of[unit_sent[y - 1]][1] if y == b or unit_fresh[y] else place(i, y)
            segments.append({"start": place(i, x), "end": end, "lang": net.labels[g], "confidence": float(share[g]), "n_sentences": int(unit_sent[y - 1] - unit_sent[x]) + 1, "n_bytes": int(w)})
        out.append(([net.labels[g] for g in have], segments))
    return out


def languages(df: DataFrame, row_id: Column, text: Column, net: ByteGRU, label: Column | None = None, segments: bool = True, switch: float = SWITCH, docs: int = 256) -> DataFrame:
    """(id, label, langs, confidence, segments) of every document whose text is not blank.

    ``label`` is passed through. ``confidence`` is the byte-weighted confidence
    of the segments in a held language; segment offsets count characters of the
    lower-cased, composed text. ``segments=False`` leaves that column null.
    """
    shared = df.sparkSession.sparkContext.broadcast((net.labels, net.h, net.p, net.pair_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, h, p, pair_id = shared.value
        own = ByteGRU(labels, h, pair_id=pair_id)
        own.p = p
        for b in batches:
            for at in range(0, b.num_rows, docs):
                s = b.slice(at, docs)
                rows = []
                for i, g, r in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), label_texts(own, s.column(2).to_pylist(), switch)):
                    if r:
                        w = [(x["n_bytes"], x["confidence"]) for x in r[1] if x["lang"] in r[0]]
                        rows.append({"id": i, "label": g, "langs": r[0], "confidence": sum(n * c for n, c in w) / sum(n for n, _ in w), "segments": r[1] if segments else None})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    label = F.lit(None).cast("string") if label is None else label
    return df.select(row_id.cast("long").alias("id"), label.alias("label"), text.alias("text")).mapInArrow(run, SCHEMA)


def _training_rows(samples: DataFrame, docs: DataFrame | None, labels: DataFrame | None, per_language: int) -> tuple[list, list]:
    """(language, text) samples and short labelled documents: at most so many a language, in the order of a hash."""
    by = lambda *o: F.row_number().over(Window.partitionBy("code").orderBy(*o))
    known = samples.select(F.col("lang").alias("code"), "text").where("code is not null and text is not null").withColumn("rank", by(F.xxhash64("text"), "text"))
    rows = sorted((r["code"], r["text"]) for r in known.where(F.col("rank") <= PER_LANGUAGE_SAMPLES).collect())
    extra: list[tuple[str, str]] = []
    if docs is not None and labels is not None and per_language:
        code = labels.where("code is not null").groupBy("label").agg(F.min("code").alias("code"))
        short = docs.where(F.length("text").between(20, 400)).select("lang", "text", F.xxhash64("doc_id").alias("h"))
        some = short.join(small(code), F.col("lang") == F.col("label")).withColumn("rank", by("h", "text")).where(F.col("rank") <= per_language)
        extra = [(r["code"], r["text"]) for r in sorted(some.select("code", "rank", "text").collect())]
    return rows, extra


def _stored(spark: SparkSession, name: str, make) -> ByteGRU:
    """The network of that name in the shared folder; made and written there once."""
    path = f"{shared_folder(spark).rstrip('/')}/merloom-byte-gru-{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        net = make()
        blob = io.BytesIO()
        np.savez(blob, labels=np.array(net.labels), hidden=np.array(net.h), pair_id=net.pair_id, **{f"p_{k}": v for k, v in net.p.items()})
        spark.createDataFrame([(bytearray(blob.getvalue()),)], "net binary").coalesce(1).write.mode("overwrite").parquet(path)
        return net
    z = np.load(io.BytesIO(bytes(spark.read.parquet(path).first()["net"])))
    net = ByteGRU([str(x) for x in z["labels"]], int(z["hidden"]), pair_id=z["pair_id"])
    net.p = {k[2:]: z[k] for k in z.files if k.startswith("p_")}
    return net


def fit(samples: DataFrame, docs: DataFrame | None = None, labels: DataFrame | None = None, per_language: int = PER_LANGUAGE, hidden: int = 24, epochs: int = 40) -> ByteGRU:
    """Train on ``samples`` (lang, text) and on at most ``per_language`` short labelled documents of each language.

    Documents of 20 to 400 characters are taken in the order of a hash of their
    id. The network is stored under a hash of its training texts and
    parameters, and loaded where it is there already.
    """
    rows, extra = _training_rows(samples, docs, labels, per_language)
    name = hashlib.sha256(repr((VERSION, hidden, epochs, rows, extra)).encode()).hexdigest()[:32]
    return _stored(samples.sparkSession, name, lambda: train(rows, extra, hidden, epochs))
