"""Template residue and error-page text: positive-unlabelled naive Bayes fitted by expectation-maximization.

Records are split into passages; a passage's features are its words, word pairs and placeholder styles, hashed to a
table of fixed size. Trusted records, found by strict patterns (two or more styles of unmistakable placeholders, or
mostly stock error phrases, or a few words over and over), give the positive passages; all others are unlabelled. The first model takes the
unlabelled ones as negative; then posteriors and model are computed in turn over all passages of all records.
Passages are scored with the last model and records decided: one passage whose placeholder the model
takes for residue is enough; otherwise all content passages (all but heading, menu and trailer) must be residue.

Defined results: null ids, null and blank texts are no case; repeated texts get equal decisions; an empty table, or
one without any trusted record, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.llm.text import rendered
from momentlake.session import shared_folder

BITS = 18
TABLE = 1 << BITS
#: Passages with a placeholder are slots (residue) or explain it; the others are messages or fillers (residue) or notes.
CLASSES = ("slot", "explained", "message", "note")
#: A row holds the passages of up to ``BLOCK`` records as plain arrays: what Spark carries between rounds is bytes, not elements.
BLOCK = 512
PARTS = {"docs": "<i8", "passages": "<i4", "low": "<u2", "high": "u1", "lengths": "<i4", "role": "i1", "placeholder": "i1", "trusted": "?"}
FEATURE_SCHEMA = ", ".join(f"{c} binary" for c in PARTS)

# Notations in which templates mark a place for a value, each with texts of which one must occur; the strict ones hardly occur in notes otherwise.
STRICT_STYLES = {
    "triple": (r"\{\{\{[^{}\n]+\}\}\}", ("{{{",)),
    "erb": (r"<%=?[^%\n]+%>", ("<%",)),
    "block": (r"\{%[^%\n]+%\}", ("{%",)),
    "format": (r"%\([^()\n]+\)[a-z]", ("%(",)),
    "percent": (r"%[A-Za-z][\w.\-]+%", ("%",)),
    "dollars": (r"\$[A-Za-z][\w.\-]+\$", ("$",)),
    "dollar": (r"\$\{[^{}\n]+\}", ("${",)),
    "squares": (r"\[\[[^\[\]\n]+\]\]", ("[[",)),
    "angles": (r"<<[^<>\n]+>>", ("<<",)),
    "ats": (r"@@[^@\n]+@@", ("@@",)),
    "under": (r"__[A-Za-z](?:_?[^\W_])*__", ("__",)),
    "hash": (r"#[A-Za-z][\w.\-]+#", ("#",)),
    "insert": (r"(?i)\[(?:insert|tbd|todo|tbc|enter|\.\.\.|escriba|hier|यहाँ)[^\[\]\n]*\]|\[[^\[\]\n]+(?:eintragen|einfügen|लिखें|aquí|here)\]", ("[",)),
    "your": (r"(?i)\(your [^()\n]+ here\)", ("(",)),
    "object": (r"(?i)\[object \w+\]", ("[",)),
    "cell": (r"#(?:REF!|N/A|NAME\?|VALUE!|DIV/0!|NULL!)", ("#",)),
    "mask": (r"\bX{1,4}:XX(?::XX)?\b|\bNaN:NaN\b", ("X:XX", "NaN:")),
}
LOOSE_STYLES = {
    "double": (r"\{\{[^{}\n]+\}\}", ("{{",)),
    "brace": (r"\{[A-Za-z][\w.\- ]*\}|\{\d{1,2}\}", ("{",)),
    "angle": (r"<[A-Za-z][\w.\- ]+>", ("<",)),
    "nothing": (r"\b(?:undefined|NaN|None|Invalid Date|null)\b", ("undefined", "NaN", "None", "Invalid", "null")),
}
# How unmistakable error messages, notices and fillers begin or end, in the languages of the corpus. A seed: the model finds what else goes with them.
BEGINS = (
    "page not found", "not found", "access denied", "permission denied", "forbidden", "unauthorized", "gone", "bad gateway", "gateway time", "service unavailable",
    "internal server", "internal failure", "too many requests", "too many searches", "connection re", "connection timed out", "database is locked", "something went wrong", "traceback (most recent call last)", "error code", "oops",
    "http 4", "http 5", "error 4", "error 5", "400 bad", "401 un", "403 f", "404", "410 gone", "429 too", "500 int", "502 bad", "503 serv", "504 gate",
    "your session has", "are you a human", "we looked everywhere", "unable to load", "unable to show", "unable to open", "unable to display", "unable to see", "enable javascript", "enable cookies", "enable scripts", "allow javascript", "allow cookies",
    "turn on javascript", "turn on cookies", "turn on scripts", "switch on javascript", "switch on cookies", "switch on scripts", "switch on client-side", "turn on client-side", "please enable", "please allow", "please turn on javascript",
    "javascript is", "javascript must", "javascript required", "scripting disabled", "scripting is disabled", "scripts are required", "cookies and scripts are", "cookies and javascript", "you need to enable", "you need to allow", "you need javascript", "you need scripts", "you need client-side",
    "this page needs", "this page requires", "this viewer needs", "this viewer requires", "this site requires", "your browser does not support", "it looks as if javascript", "it looks as if scripts", "it looks as if client-side", "it looks as if cookies",
    "we cannot load", "we cannot show", "we cannot play", "we cannot open", "we cannot draw",
    "lorem ipsum", "text goes here", "your text", "your description goes", "placeholder text", "caption to follow", "replace this", "delete this", "describe the", "insert your", "enter your", "write your",
    "seite nicht gefunden", "zugriff verweigert", "bitte aktivieren sie", "der dienst ist", "die seite konnte nicht", "für diese ansicht müssen", "für diese seite müssen", "blindtext", "platzhalter", "beschreiben sie hier", "geben sie hier",
    "página no encontrada", "acceso denegado", "active javascript", "este visor necesita", "esta página requiere", "este sitio requiere", "el servicio no est", "texto de relleno", "texto de ejemplo", "escriba aquí",
    "पृष्ठ नहीं मिला", "सेवा अभी उपलब्ध नहीं", "पहुँच अस्वीकृत", "कृपया javascript", "कृपया जावास्क्रिप्ट",
)
ENDS = (
    "is offline", "has expired", "was refused by the gateway", "could not be reached", "could not be loaded", "could not be found", "an unexpected error", "does not exist any more", "no longer exists",
    "is temporarily unavailable", "is currently unavailable", "missing or blocked", "is turned off", "is locked", "are required", "जावास्क्रिप्ट चालू करें",
)


def _stock(passage: str) -> bool:
    low = passage[:200].lower()
    return low.startswith(BEGINS) or (len(passage) < 60 and low.rstrip(" .!।").endswith(ENDS))


_STYLES = [(f" ⟦{name}{end}⟧ ", triggers, re.compile(p)) for styles, end in ((STRICT_STYLES, "_strict"), (LOOSE_STYLES, "")) for name, (p, triggers) in styles.items()]
_RULE = re.compile(r"([^\s\d])\1{9,}")
_SENTENCE = re.compile("|".join(f"{end}[\"”'’)]* " for end in (r"\.", "!", r"\?", "।")) + r"|\|(?<= \|)(?= )|-(?<=\w -)(?= [\w<\[{%$#@])|:(?<=\w:)(?= )")
_STYLE = re.compile(r"⟦([a-z]\w*)⟧")
_TOKEN = re.compile(r"⟦\w+⟧|[^\W\d_]+|\d+|[\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+")
_CLOSING = "\"”'’)"
CONTENT, HEADING, SHORT = 0, 1, 2


class _Hashes(dict):
    """Token -> 32-bit hash, digits as one sign and placeholders as another; filled as tokens are met."""

    def __missing__(self, token: str) -> int:
        sign = "#" if token[0].isdigit() else "⟦⟧" if token[0] == "⟦" and token[1] != "_" else token
        if len(self) > 1 << 20:
            self.clear()
        value = self[token] = xxhash.xxh32_intdigest(sign)
        return value


_HASHES = _Hashes()
_EDGES = [xxhash.xxh32_intdigest(e) for e in ("^", "$")]


def _marked(text: str) -> str:
    """A rendered text with its placeholders, and runs of ten equal characters, as marks."""
    text = rendered(text, all_tags=False)
    for c in set(text):
        if c * 10 in text:
            text = _RULE.sub(" ⟦_rule⟧ ", text)
            break
    for mark, triggers, pattern in _STYLES:
        for t in triggers:
            if t in text:
                text = pattern.sub(mark, text)
                break
    return text


def passages(text: str) -> list[tuple[str, list[str], int]]:
    """The passages of a text: wording, placeholder styles (strict ones with a ``_strict``) and role."""
    parts = []  # wording and what parts it from the next
    for line in _marked(text).split("\n"):
        line, last = " ".join(line.split()), 0
        for m in _SENTENCE.finditer(line):
            mark = m.group()
            cut = m.end() if mark[0] in ".!?।" else m.start()
            parts.append((line[last:cut].strip(), mark))
            last = m.end()
        parts.append((line[last:].strip(), "\n"))
    parts = [(p, gap, _STYLE.findall(p) if "⟦" in p else []) for p, gap in parts if p and ("⟦" in p or p[0].isalnum() or re.search(r"\w", p))]
    out, leading = [], True
    for i, (p, gap, styles) in enumerate(parts):
        stock = None
        if leading:
            stock = _stock(p)
            leading = not stock and p.rstrip(_CLOSING)[-1:] not in ".!?।" and i < min(2, len(parts) - 1) and gap[0] in "\n|-:"
        short = not leading and len(p) < 80 and len(_WORD.findall(p)) < 4 and not (_stock(p) if stock is None else stock)
        out.append((p, styles, HEADING if leading else SHORT if short else CONTENT))
    if all(role != CONTENT for *_, role in out):  # nothing longer: the short ones are the content, or else the heading; of these those with words only, or else with words
        kind = SHORT if any(role == SHORT for *_, role in out) else HEADING
        worth = [0 if role != kind else 1 if not _WORD.search(p) else 2 if re.search(r"\d", p) else 3 for p, _, role in out]
        out = [(p, s, CONTENT if w == max(worth) else role) for (p, s, role), w in zip(out, worth)]
    return out


def features(tokens: list[list[str]], styles: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of passages (their tokens, their styles): each passage's different ones one after the other, and how many it has.

    Features are words (digits as one sign), neighbouring pairs and placeholder styles, as buckets of the table.
    """
    n = len(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, n)
    own = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(tokens)), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(n, dtype=np.uint64), sizes)
    # with an edge before and after each passage, so that first and last words make pairs as well
    framed = np.empty(len(own) + 2 * n, np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])
    framed[starts[:-1]], framed[starts[1:] - 1] = _EDGES
    inner = np.ones(len(framed), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    framed[inner] = own
    pair = np.ones(max(len(framed) - 1, 0), bool)
    pair[starts[1:-1] - 1] = False
    left, right = framed[:-1][pair], framed[1:][pair]
    marks = np.fromiter((xxhash.xxh32_intdigest("style " + x) for s in styles for x in s), np.uint64)
    marked = np.repeat(np.arange(n, dtype=np.uint64), [len(s) for s in styles])

    def bucket(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)

    mixed = left * np.uint64(0x100000001B3) + (right ^ (right << np.uint64(29))) + np.uint64(1)
    key = np.concatenate([owner << np.uint64(BITS) | bucket(own), np.repeat(np.arange(n, dtype=np.uint64), sizes + 1) << np.uint64(BITS) | bucket(mixed), marked << np.uint64(BITS) | bucket(marks)])
    key.sort()
    key = key[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])]
    return (key & np.uint64(TABLE - 1)).astype(np.int32), np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=n)


def _featured(batches):
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield _featured_part(b.slice(at, BLOCK))


def _featured_part(b: pa.RecordBatch) -> pa.RecordBatch:
    docs, counts, roles, placeholders, trusted, tokens, marks = [], [], [], [], [], [], []
    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        found = passages(text)
        if not found:
            continue
        strict = {s for _, styles, _ in found for s in styles if s.endswith("_strict")}
        words = [_TOKEN.findall(p.casefold()) for p, *_ in found]
        spoken = [w for t, (*_, role) in zip(words, found) if role == CONTENT for w in t if w[0].isalpha()]
        droning = len(spoken) >= 6 and len(set(spoken)) <= 8 and len(spoken) >= 4 * len(set(spoken))  # a few words over and over
        known = [_stock(p) or p == "⟦_rule⟧" for p, _, role in found if role == CONTENT]
        stock = droning or all(known) or (known[0] and len(known) <= 4 and 2 * sum(known) >= len(known))
        docs.append(doc)
        counts.append(len(found))
        for (_, styles, role), w in zip(found, words):
            hard = any(x.endswith("_strict") for x in styles)
            roles.append(role)
            placeholders.append(2 if hard else int(bool(styles)))
            trusted.append((stock and role != HEADING) or (len(strict) > 1 and hard))
            tokens.append(w)
            marks.append(styles)
    f, sizes = features(tokens, marks)
    parts = {"docs": docs, "passages": counts, "low": f & 0xFFFF, "high": f >> 16, "lengths": sizes, "role": roles, "placeholder": placeholders, "trusted": trusted}
    return pa.RecordBatch.from_arrays([pa.array([np.asarray(parts[c]).astype(kind).tobytes()], pa.binary()) for c, kind in PARTS.items()], list(PARTS))


def _flat(block: dict[str, np.ndarray]):
    """Of a block: feature ids, passage number of each, passage arrays, record number of each passage."""
    f = block["low"].astype(np.int64) | block["high"].astype(np.int64) << 16
    record = np.repeat(np.arange(len(block["docs"])), block["passages"])
    return f, np.repeat(np.arange(len(block["lengths"])), block["lengths"]), block["role"], block["placeholder"], block["trusted"], record


def blocks(b: pa.RecordBatch):
    """The blocks of a batch of rows."""
    for row in zip(*b.columns):
        yield {c: np.frombuffer(v.as_buffer(), kind) for (c, kind), v in zip(PARTS.items(), row)}


def _weights(counts: pa.Table, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds, per feature and prior, of slot against explained and of message against note, from the summed weights (bucket -1: the passages themselves).

    Slots stand in the wording of notes, so the classes with placeholders, and also the few messages, are smoothed towards the notes. A passage's
    own vote is no evidence that its wording explains a placeholder or is a message, so one vote is taken off there.
    """
    bucket = counts.column("bucket").to_numpy()
    real = bucket >= 0
    sums, sizes = np.zeros((4, TABLE)), np.zeros(4)
    for i, c in enumerate(CLASSES):
        w = counts.column(c).to_numpy()
        sums[i, bucket[real]] = w[real]
        sizes[i] = max(float(w[~real].sum()), 1e-3)
    slot, explained, message, note = sums
    usual = (note + 0.5) / (sizes[3] + 1)  # a feature never seen tells nothing
    among = lambda c, n, s=strength: np.log((c + s * n * usual) / (n * (1 + s)))
    odds = np.stack([among(slot, sizes[0]) - among(np.maximum(explained - 1, 0), sizes[1]), among(np.maximum(message - 1, 0), sizes[2], strength / 3) - np.log(usual)])
    return odds.astype(np.float32), np.log(np.array([sizes[0] / sizes[1], sizes[2] / sizes[3]]))


def _odds(block: dict[str, np.ndarray], model) -> tuple[np.ndarray, ...]:
    """Log-odds of a block's passages to be residue (with a placeholder: a slot, else: a message), and what ``_flat`` gives."""
    f, owner, role, ph, trusted, record = _flat(block)
    weight, prior = model
    slot, message = (prior[i] + np.bincount(owner, weight[i][f], len(role)) for i in (0, 1))
    return np.where(ph > 0, slot, message), f, owner, role, ph, trusted, record


def weigh(block: dict[str, np.ndarray], model) -> tuple[np.ndarray, np.ndarray]:
    """Of a block, per class the summed posteriors by feature and altogether; without a model yet, the trusted passages against all others."""
    if model is None:
        f, owner, _, ph, trusted, _ = _flat(block)
        bad = np.where(ph == 2, 0.5, 0.0)  # an unmistakable notation, but the only one of its record
    else:
        odds, f, owner, _, ph, trusted, _ = _odds(block, model)
        bad = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    bad[trusted], ph = 1, ph > 0
    w = np.stack([bad * ph, (1 - bad) * ph, bad * ~ph, (1 - bad) * ~ph])
    return np.stack([np.bincount(f, x[owner], TABLE) for x in w]), w.sum(1)


def decided(block: dict[str, np.ndarray], model) -> pa.RecordBatch:
    """The records of a block that are residue by the model's odds."""
    odds, _, _, role, ph, _, record = _odds(block, model)
    residue, content, n = odds > 0, role == CONTENT, len(block["docs"])
    total, bad = np.bincount(record[content], minlength=n), np.bincount(record[content & residue], minlength=n)
    slot = np.bincount(record[(ph > 0) & residue], minlength=n) > 0
    hit = np.nonzero(slot | (bad == total))[0]
    return pa.RecordBatch.from_arrays([pa.array(block["docs"][hit]), pa.array(total[hit], pa.int32()), pa.array(bad[hit], pa.int32()), pa.array(slot[hit])], ["doc_id", "n_passages", "n_residue", "placeholder"])


def residue_documents(df: DataFrame, id_col: str, text_col: str, *, rounds: int = 4, strength: float = 2.0) -> DataFrame:
    """``(doc_id, n_passages, n_residue, placeholder)`` of the records that hold template residue or nothing but error or filler text."""
    spark = df.sparkSession
    shared_folder(spark)
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = texts.mapInArrow(_featured, FEATURE_SCHEMA).checkpoint()
    # a task sends at most TABLE rows a round; few tasks for each core keep that small beside what they read
    parts, cores = docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    counted = docs.coalesce(max(4 * cores, parts // 8)) if parts > 4 * cores else docs
    model = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def count(batches, shared=shared):
            sums, total = np.zeros((4, TABLE)), np.zeros(4)
            for block in (x for b in batches for x in blocks(b)):
                part, whole = weigh(block, shared.value)
                sums += part
                total += whole
            used = np.nonzero(sums.sum(0) > 0)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used], pa.int32()), *(pa.array(np.r_[total[i], sums[i][used]]) for i in range(4))], ["bucket", *CLASSES])

        counts = counted.mapInArrow(count, "bucket int, slot double, explained double, message double, note double").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in CLASSES)).toArrow()  # at most TABLE + 1 rows
        seen = counts.filter(pa.compute.less(counts.column("bucket"), 0))
        if not seen.num_rows or seen.column("slot")[0].as_py() + seen.column("message")[0].as_py() == 0:
            return spark.createDataFrame([], "doc_id long, n_passages int, n_residue int, placeholder boolean")
        model = _weights(counts, strength)
    last = spark.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda batches: (decided(block, last.value) for b in batches for block in blocks(b)), "doc_id long, n_passages int, n_residue int, placeholder boolean")
