"""Personal data in texts: base patterns, and further spans by weak supervision.

Base spans follow fixed patterns and checks and always stay. Beside them, looser patterns propose candidates: e-mail addresses
written out ("name at host dot org"), telephone numbers without a country code, numbers that fail a check. Labelers vote on
every candidate, for, against or not at all: the form, a gazetteer (endings of hosts, card issuers, area codes), the words
before it, and what stands around it. Nobody has labelled anything: expectation-maximisation over the counts of vote patterns
of the whole corpus estimates how far each labeler can be trusted, and a logistic span classifier is trained on the resulting
probabilities, with features of its own. It decides on the candidates that are no base spans. A candidate that fails its
kind's check (checksum, range of a byte) is counted but never becomes a span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.storage import lean, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "context", "surroundings")
BATCH_BYTES = 4 << 20
#: Characters before a candidate whose words count as its context.
NEAR = 48

# Digits are matched possessively and a number is only tried at its start: what fails there fails at its later digits too.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{1,63}\s?(?:\(at\)|\[at\]|\{at\}|\bat\b)\s?[A-Za-z0-9-]{2,63}"
    r"(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\bdot\b)\s?[A-Za-z0-9-]{2,63}){1,4}", re.I
)
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])")

#: Fixed word lists of the context labeler.
CONTEXT = {
    "email": "email mail e-mail contact write reply courriel correo kontakt contacto",
    "ip": "ip address host server client login adresse dirección",
    "card": "card visa mastercard amex credit debit pay karte carte tarjeta kreditkarte",
    "phone": "phone tel telephone call mobile cell fax sms whatsapp téléphone telefon teléfono handy móvil appelez",
}
AGAINST = "version isbn issn order invoice id serial token key hash revision build model article".split()
#: Fixed list of frequent endings of host names.
ENDINGS = "com org net edu gov mil int info biz name io co de fr es uk eu us ca at ch it nl be pl se no dk fi pt br mx ar cl jp cn in au nz ru".split()
WORDS_OF = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
WORD_AGAINST, ENDING_SET = frozenset(AGAINST), frozenset(ENDINGS)
WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def matches(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, by start and then by kind; and matches of base patterns that fail their checks."""
    good, failed = [], []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            good.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            fits = all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in (x[-8:] if not x[:-8].strip("0") else "999" for x in m.groups()))
            (good if fits else failed).append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                (good if luhn(digits) else failed).append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    good.append(("phone", *m.span()))
    return sorted(good, key=lambda s: (s[1], KINDS.index(s[0]))), failed


def looser(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the looser patterns that overlap none of the taken spans."""
    found = []
    low = text.lower() if "dot" in text or "DOT" in text or "Dot" in text else ""
    if "dot" in low:
        found += [("email", *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        found += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
    return [s for s in found if not any(a < s[2] and b > s[1] for _, a, b in taken)]


def votes(text: str, kind: str, start: int, end: int, base: bool, failed: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 none."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    form = 1 if base else -1 if failed else 0
    if kind == "email":
        known = re.split(r"[^A-Za-z0-9]+", span.rstrip(")]}"))[-1].lower() in ENDING_SET
        listed = 1 if known else -1
    elif kind == "card":
        listed = 1 if digits[0] in "45" or digits[:2] in ("34", "37", "65") or digits[:4] == "6011" or "2221" <= digits[:4] <= "2720" else -1
    elif kind == "phone":
        national = digits[-10:] if len(digits) >= 10 else digits
        listed = 1 if span[0] in "+(" or (national[0] in "23456789" and national[3:4] in tuple("23456789")) else 0
    else:
        listed = -1 if span.startswith(("0.", "127.", "255.")) else 0
    near = [w.lower() for w in WORD.findall(text[max(0, start - NEAR): start])][-4:]
    context = 1 if any(w in WORDS_OF[kind] for w in near) else -1 if any(w in WORD_AGAINST for w in near) else 0
    before, after = text[start - 1: start], text[end: end + 1]
    apart = (not before or not (before.isalnum() or before in "._-=/#\"'")) and (not after or not (after.isalnum() or after in "_-=/#\"'"))
    return form, listed, context, 1 if apart else -1


def features(kind: str, vote: tuple[int, ...], length: int) -> list[float]:
    """What the final classifier sees: the votes without the form's (which tells base spans apart), the kind and the length."""
    out = [1.0] + [float(kind == k) for k in KINDS]
    for v in vote[1:]:
        out += [float(v > 0), float(v < 0)]
    return [*out, float(vote[0] < 0), min(length, 64) / 64]


FOUND = "doc_id long, base string, kinds array<string>, starts array<long>, ends array<long>, votes array<string>"


def look(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """Base spans, and all candidates (base ones first) with their votes."""
    base, failed = matches(text)
    every = [(s, True, False) for s in base] + [(s, False, True) for s in failed] + [(s, False, False) for s in looser(text, base + failed)]
    return base, [(*s, ",".join(map(str, votes(text, *s, b, f)))) for s, b, f in every]


def candidates(docs: DataFrame) -> DataFrame:
    """Base spans and voted candidates of each row's whole text (null: empty)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.by_bytes(batches, "text", BATCH_BYTES):
            base, found = [], []
            for text in table["text"].to_pylist():
                b, f = look(text or "")
                base.append(joined(b))
                found.append(f)
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array(base, pa.string())]
                + [pa.array([[c[i] for c in f] for f in found], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["doc_id", "base", "kinds", "starts", "ends", "votes"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(find), FOUND)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- models

@dataclass
class Model:
    reliability: dict[str, np.ndarray]  # by kind: labelers x (right when true, right when false)
    weights: np.ndarray
    threshold: float

    def accepts(self, kind: str, vote: tuple[int, ...], length: int) -> bool:
        """Whether a candidate outside the base becomes a span. It takes the classifier, and a labeler that speaks for it."""
        if vote[0] < 0 or max(vote[1:3]) <= 0 or min(vote[1:]) < 0:
            return False
        return 1 / (1 + np.exp(-float(np.dot(features(kind, vote, length), self.weights)))) >= self.threshold


def estimate(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes and independent labelers: their reliabilities, and each pattern's probability of being true.

    Reliabilities start, and are held by a weak prior, at four fifths; the form's prior is the strongest, which tells the two
    classes apart.
    """
    votes_ = np.array(patterns)
    prior = np.full((votes_.shape[1], 2), 0.8)
    strength = np.array([50.0] + [5.0] * (votes_.shape[1] - 1))[:, None]
    right, share = prior.copy(), 0.5
    for _ in range(rounds):
        yes, no = np.log(share), np.log1p(-share)
        for j in range(votes_.shape[1]):
            yes = yes + np.where(votes_[:, j] > 0, np.log(right[j, 0]), np.where(votes_[:, j] < 0, np.log1p(-right[j, 0]), 0))
            no = no + np.where(votes_[:, j] < 0, np.log(right[j, 1]), np.where(votes_[:, j] > 0, np.log1p(-right[j, 1]), 0))
        p = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        w1, w0 = counts * p, counts * (1 - p)
        share = float(np.clip((w1.sum() + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4))
        voted, up, down = votes_ != 0, votes_ > 0, votes_ < 0
        right = np.stack([
            (w1 @ up + (strength * prior)[:, 0]) / (w1 @ voted + strength[:, 0]), (w0 @ down + (strength * prior)[:, 1]) / (w0 @ voted + strength[:, 0]),
        ], axis=1).clip(0.01, 0.99)
    return right, p


def fit(found: DataFrame, threshold: float = 0.5) -> Model:
    """Reliabilities and classifier from all candidates of the corpus.

    What the driver gets are counts of (kind, votes, length class): at most 4 x 81 x 5 rows, however large the corpus.
    """
    one = found.select(F.explode(F.arrays_zip("kinds", "starts", "ends", "votes")).alias("c"))
    step = F.least(F.floor((F.col("c.ends") - F.col("c.starts")) / 16), F.lit(4)).cast("int")
    rows = one.groupBy(F.col("c.kinds").alias("kind"), F.col("c.votes").alias("votes"), step.alias("step")).count().collect()
    rows = sorted((r.kind, tuple(map(int, r.votes.split(","))), r.step, r["count"]) for r in rows)
    reliability, x, y, n = {}, [], [], []
    for kind in KINDS:
        own = [r for r in rows if r[0] == kind]
        if own:
            counts = np.array([r[3] for r in own], np.float64)
            reliability[kind], p = estimate([r[1] for r in own], counts)
            x += [features(kind, r[1], 16 * r[2] + 8) for r in own]
            y += p.tolist()
            n += counts.tolist()
    size = len(features("email", (0,) * len(LABELERS), 0))
    weights = np.zeros(size)
    if x:
        x, y, n = np.array(x), np.array(y), np.array(n)
        for _ in range(50):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (n * (p - y)) + weights
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(size)
            weights = weights - np.linalg.solve(curve, slope)
    return Model(reliability, weights, threshold)


def decided(base: str, kinds, starts, ends, vote, model: Model) -> list[tuple[str, int, int]]:
    """All spans of a text: its base spans and the accepted candidates, by start and then by kind."""
    spans = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)}
    for k, a, b, v in zip(kinds, starts, ends, vote):
        if (k, int(a), int(b)) not in spans and model.accepts(k, tuple(map(int, v.split(","))), int(b) - int(a)):
            spans.add((k, int(a), int(b)))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def detect(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)` per row of `docs` (`doc_id`, `text`; others are ignored).

    The four counts and the digest are of the base spans, `spans` lists all, `n_added` counts those beyond the base. Null and
    empty texts have no spans. Repeated rows and null ids are rows of their own.
    """
    found = written(candidates(docs), "candidates")
    model = fit(found)

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            spans = [decided(*row, model) for row in zip(f["base"], f["kinds"], f["starts"], f["ends"], f["votes"])]
            base = [[s.split(":")[0] for s in b.split(",") if s] for b in f["base"]]
            out = {"doc_id": f["doc_id"].astype("Int64")} | {f"n_{k}": np.array([b.count(k) for b in base], np.int64) for k in KINDS}
            out |= {"base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in f["base"]], "spans": [joined(s) for s in spans]}
            yield pd.DataFrame(out | {"n_added": np.array([len(s) - len(b) for s, b in zip(spans, base)], np.int64)})

    return found.mapInPandas(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of its texts replaced; `n_chars`, where there is such a column, follows. Null texts stay null."""
    model = fit(written(candidates(docs), "candidates"))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.by_bytes(batches, "text", BATCH_BYTES):
            texts = []
            for text in table["text"].to_pylist():
                base, every = look(text or "")
                texts.append(text if not every else redacted_text(text, decided(joined(base), *zip(*every), model)))
            out = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield from out.combine_chunks().to_batches()

    out = docs.mapInArrow(lean(replace), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
