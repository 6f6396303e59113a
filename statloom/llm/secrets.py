"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.session import fresh_path

#: Labelled findings of each class that the forest is fitted on at most, chosen by a hash.
LABELLED = 2000
TREES, DEPTH = 24, 6
#: What replaces a secret.
MASK = "[SECRET]"

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{12,}={0,2}")
#: Forms that are secrets whatever stands around them, each with a text that it cannot do without.
FORMS = {
    "pem": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?P<secret>(?:[^\-]|-(?!----))++(?=-----END )|(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})+)")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_\-])(?P<secret>eyJ[A-Za-z0-9_\-]{5,}(?:\.[A-Za-z0-9_\-]*){2,4})")),
    "url": ("://", re.compile(r"://[^\s/:@]*:(?P<secret>[^\s/]+)@")),
    "issued": ("", re.compile(r"(?<![A-Za-z0-9])(?P<secret>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")),
}
_ISSUERS = re.compile("A[KS]IA|gh[pousr]_|sk_(?:live|test)_|xox[abprs]-")
#: A name that ends with or holds a key word and what assigns a value to it; the value is quoted, or goes on up to
#: white space or the next name.
ASSIGNMENT = re.compile(
    r"(?:passw(?:or)?d|passphrase|pwd|secret|token|credential|(?<![a-z])auth(?!or(?!iz))|bearer|private|(?:(?<![a-z])|api|access|private|secret|auth|signing|encryption|master|client)key)"
    r"[a-z0-9_.\-]{0,40}[\\\"'\]]*\s*(?::=|=>|=(?!=)|:(?!:|//))\s*(?:(?:bearer|basic|token)\s+(?=\S))?",
    re.IGNORECASE,
)
_QUOTED = re.compile(r"\"(?P<double>(?:[^\"\\\n]|\\.)++)\"|'(?P<single>(?:[^'\\\n]|\\.)++)'")
_BARE = re.compile(r"(?:(?![&;,][\w.\-]+[=:])\S)+")
#: Values that name a secret without being one: variables, placeholders, calls, constants.
_REFERENCE = re.compile(r"\$.*|<.*>|\{\{.*|%\(?\w*\)?s|[*xX.•\-_]+|(?:none|null|nil|true|false|undefined|required|optional|string|str|text)|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+|[A-Za-z_][\w.]*[(\[].*", re.IGNORECASE)
_PASSWORDS = re.compile(r"passw|passphrase|pwd|secret|credential", re.IGNORECASE)
_KEY_WORDS = frozenset("password passwd pwd secret token key apikey api_key access_key credential credentials auth bearer private".split())
_ASSIGNED = re.compile(r"([A-Za-z_\-]{2,40})[\"']?\s*(?:=|:|:=|=>)\s*[\"']?$")
_WORD = re.compile(r"[a-z]{3,}")
_VOWELS = frozenset("aeiouy")

FEATURES = [
    "length", "entropy", "digits", "upper", "lower", "hexadecimal", "class_changes", "vowel_changes",
    "dictionary", "in_path", "in_address", "quoted", "assigned", "key_word_before", "key_word_near", "longest_digits",
]


def dictionary(path: str) -> frozenset[str]:
    """Lower-case words of four letters or more that a public sentencepiece vocabulary holds whole."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return frozenset(p[1:].lower() for p in pieces if p.startswith("▁") and len(p) > 4 and p[1:].isascii() and p[1:].isalpha())


class Candidate(NamedTuple):
    """A part of a text: one of FORMS, a value "assigned" to a key word, or a "run" of key characters."""

    start: int
    end: int
    form: str
    #: Of assigned values: whether they are given to a password, and whether they only refer to one.
    password: bool = False
    reference: bool = False


def candidates(text: str | None) -> Iterator[Candidate]:
    """What has one of FORMS, runs of twelve or more key characters that hold a digit, or capitals inside, and
    whole values assigned to key words, whatever their characters and length.

    They come in the order of the text; runs and values inside of a form are part of it, and a value that is
    a run counts once.
    """
    text = text or ""
    found = [
        Candidate(*m.span("secret"), form)
        for form, (needed, pattern) in FORMS.items()
        if (needed in text if needed else _ISSUERS.search(text))
        for m in pattern.finditer(text)
    ]
    found += _assigned(text)
    outer, given = 0, {(c.start, c.end) for c in found if c.form == "assigned"}
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) or sum(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False)) >= 2:
            if m.span() not in given:
                found.append(Candidate(m.start(), m.end(), "run"))
    for c in sorted(found, key=lambda c: (c.start, c.form not in FORMS, -c.end)):
        if c.end > outer or c.form in FORMS:
            yield c
        if c.form in FORMS:
            outer = max(outer, c.end)


def _assigned(text: str) -> Iterator[Candidate]:
    """Values assigned to key words. A value may hold assignments itself, as in "secrets: token=..."; of those that end
    together the whole value and the innermost count, so that the work follows the length of the text."""
    if "=" not in text and ":" not in text:
        return
    bare_end, inner = -1, None
    for m in ASSIGNMENT.finditer(text):
        at = m.end()
        quoted = _QUOTED.match(text, at)
        if not quoted and at < bare_end:
            inner = (m.start(), at)
            continue
        if inner:
            yield from _value(text, *inner, bare_end, False)
            inner = None
        if quoted:
            yield from _value(text, m.start(), *quoted.span(quoted.lastgroup), True)
        elif bare := _BARE.match(text, at):
            bare_end = bare.end()
            yield from _value(text, m.start(), at, bare_end, False)
    if inner:
        yield from _value(text, *inner, bare_end, False)


def _value(text: str, named: int, start: int, end: int, quoted: bool) -> Iterator[Candidate]:
    """The candidate of a value whose name starts at `named`; nothing if no more than quotes and commas is left of it."""
    name, value = text[named:start], text[start:end]
    if not quoted:
        # Quotes that do not close, and what ends a list or a sentence, are no part of the value.
        bare = value.lstrip("\\\"'`")
        start, value = start + len(value) - len(bare), bare.rstrip("\\\"'`,;.)]}>")
        end = start + len(value)
    if value:
        reference = bool(_REFERENCE.fullmatch(value)) or (value.replace("_", "").isalpha() and any(k in value.lower() for k in _KEY_WORDS))
        firm = quoted or "=" in name or not value.isalpha()
        yield Candidate(start, end, "assigned", firm and len(value) >= 4 and not re.search(r"\s", value) and not reference and bool(_PASSWORDS.search(name)), reference)


def features(text: str, m: Candidate, words: frozenset[str]) -> list[float]:
    """One number per name in FEATURES, from the candidate and 60 characters on either side."""
    run, n = text[m.start : m.end], m.end - m.start
    before, after = text[max(0, m.start - 60) : m.start], text[m.end : m.end + 60]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in run]
    letters = [c.lower() in _VOWELS for c in run if c.isalpha()]
    counts = Counter(run)
    assigned = _ASSIGNED.search(before)
    named = "key" if m.form == "assigned" else assigned[1].lower() if assigned else ""
    near = set(re.findall(r"[a-z_]+", before.lower())[-4:]) | set(re.findall(r"[a-z_]+", after.lower())[:2])
    return [
        n, -sum(c / n * math.log2(c / n) for c in counts.values()), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n,
        sum(c in "0123456789abcdefABCDEF" for c in run) / n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(a != b for a, b in zip(letters, letters[1:], strict=False)) / max(1, len(letters)), _covered(run.lower(), words) / n,
        float("/" in run or before[-1:] in ("/", "\\") or after[:1] in ("/", "\\")), float(before[-1:] in ("@", ".") or after[:1] == "@"),
        float(before[-1:] in ("'", '"') and after[:1] == before[-1:]), float(assigned is not None or m.form == "assigned"),
        float(any(k in named for k in _KEY_WORDS)), float(bool(near & _KEY_WORDS)), max(map(len, re.findall(r"\d+", run)), default=0),
    ]


def _covered(run: str, words: frozenset[str]) -> int:
    """Letters of the run inside dictionary words, longest first from the left."""
    total = 0
    for stretch in _WORD.findall(run):
        at = 0
        while at < len(stretch):
            found = next((n for n in range(min(len(stretch) - at, 16), 3, -1) if stretch[at : at + n] in words), 0)
            total += found
            at += found or 1
    return total


def labelled_findings(documents: DataFrame, words: frozenset[str], most: int = LABELLED) -> DataFrame:
    """(label, features) of candidates whose nature their own form settles: at most `most` of either label.

    A finding is true (1) if it has one of FORMS, or is the value assigned to a key word and mixes digits
    with letters, or a single word of four characters or more given to a password; it is false (0) if it is
    a reference (a variable, a placeholder, a call), only digits and no assigned value, or if it does not look random and is part of an
    address or path or stands in running prose. Others stay unlabelled: that nothing near a random value
    tells its purpose does not make it harmless. The choice among all candidates of the table is by a hash.
    """
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, found, runs = [], [], []
            for text in batch["text"]:
                whole = text.as_py()
                for m in candidates(whole):
                    x = features(whole, m, shared.value)
                    label = _settled(m, x)
                    if label is not None:
                        labels.append(label)
                        found.append(x)
                        runs.append(whole[m.start : m.end])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(found, pa.list_(pa.float64())), pa.array(runs, pa.string())], ["label", "features", "run"])

    rows = documents.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(find, "label double, features array<double>, run string")
    rows = rows.dropDuplicates(["label", "run"])
    order = F.xxhash64("run"), F.col("run")
    return rows.where("label = 1").orderBy(*order).limit(most).unionByName(rows.where("label = 0").orderBy(*order).limit(most)).select("label", "features")


def _settled(m: Candidate, x: list[float]) -> float | None:
    f = dict(zip(FEATURES, x, strict=True))
    mixed = 0 < f["digits"] < 1
    if m.reference:
        return 0.0
    if m.form in FORMS or m.password or (f["key_word_before"] and mixed and f["entropy"] >= 2.5):
        return 1.0
    random = f["entropy"] >= 3 and f["upper"] + f["lower"] > 0 and f["dictionary"] < 0.4
    if (f["digits"] == 1 and m.form == "run") or (not random and (f["in_address"] or f["in_path"] or (not f["assigned"] and not f["key_word_near"]))):
        return 0.0
    return None


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, left, right, and the share of true findings in a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    always: float = 0.0

    def share(self, x: np.ndarray) -> np.ndarray:
        """The mean share of true findings over the trees."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                f = feature[at[inner]]
                at[inner] = np.where(x[inner, f] <= threshold[at[inner]], left[at[inner]], right[at[inner]])
            total += leaf[at]
        return total / len(self.trees) if self.trees else np.full(len(x), self.always)


def fit(spark: SparkSession, findings: DataFrame, seed: int = 7) -> Forest:
    """Fits Spark's random forest on labelled findings (label, features), a bounded table.

    Findings of one label only give that answer for every candidate, none at all give "false".
    """
    rows = sorted((r.label, tuple(r.features)) for r in findings.collect())
    if len({label for label, _ in rows}) < 2:
        return Forest([], rows[0][0] if rows else 0.0)
    data = spark.createDataFrame([(label, Vectors.dense(x)) for label, x in rows], ["label", "features"]).coalesce(1)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, maxBins=64).fit(data)
    path = fresh_path(spark, "forest")
    model.save(path)
    trees = []
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    for tree in range(TREES):
        own = [r for r in nodes if r.treeID == tree]
        stats = np.array([r.impurityStats for r in own])
        trees.append(
            (
                np.array([r.split.featureIndex if r.leftChild >= 0 else -1 for r in own]), np.array([r.split.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else 0.0 for r in own]),
                np.array([r.leftChild for r in own]), np.array([r.rightChild for r in own]), stats[:, 1] / stats.sum(axis=1),
            )
        )
    return Forest(trees)


def scan(documents: DataFrame, forest: Forest, words: frozenset[str], least: float = 0.5) -> DataFrame:
    """`documents` with secrets masked in text, plus n_candidates and spans (start, end, share) of the secrets.

    A candidate is a secret if its own form settles that it is one (share 1), or if the mean share of true
    findings over the trees is at least `least`. Secrets that overlap are one span. Spans count characters of the original text. A null text stays null and has none; an empty text too. Rows
    are neither lost nor merged; columns of the new names are replaced; texts are scanned whole.
    """
    held = documents.sparkSession.sparkContext.broadcast((forest, words))
    kept = documents.drop("n_candidates", "secrets")
    schema = kept.select("*", F.lit(0).cast("bigint").alias("n_candidates"), F.expr("cast(array() as array<struct<start:bigint,end:bigint,share:double>>) as secrets")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = held.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = [(i, m) for i, t in enumerate(texts) for m in candidates(t)]
            rows = [features(texts[i], m, known) for i, m in found]
            shares = model.share(np.array(rows, float).reshape(len(found), len(FEATURES)))
            shares[[_settled(m, x) == 1 for (_, m), x in zip(found, rows, strict=True)]] = 1
            counts, secrets = [0] * len(texts), [[] for _ in texts]
            for (i, m), share in zip(found, shares, strict=True):
                counts[i] += 1
                if share >= least and secrets[i] and m.start < secrets[i][-1]["end"]:
                    last = secrets[i][-1]
                    last["end"], last["share"] = max(last["end"], m.end), max(last["share"], float(share))
                elif share >= least:
                    secrets[i].append({"start": m.start, "end": m.end, "share": float(share)})
            columns = {name: batch[name] for name in batch.schema.names}
            columns["text"] = pa.array([masked(t, s) for t, s in zip(texts, secrets, strict=True)], batch.schema.field("text").type)
            columns["n_candidates"], columns["secrets"] = pa.array(counts, pa.int64()), pa.array(secrets, kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return kept.mapInArrow(run, schema)


def masked(text: str | None, secrets: list[dict]) -> str | None:
    if not text or not secrets:
        return text
    parts, at = [], 0
    for s in secrets:
        parts += [text[at : s["start"]], MASK]
        at = s["end"]
    return "".join([*parts, text[at:]])


def scan_with_own_findings(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """Labels findings of the table itself, fits the forest on them and scans the whole table."""
    words = dictionary(vocabulary_path)
    return scan(documents, fit(documents.sparkSession, labelled_findings(documents, words)), words)
