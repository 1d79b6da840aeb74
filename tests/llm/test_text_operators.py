"""Operators on documents: brute force, round trips, and the cases named in their docstrings."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import language_id, mixing, ngram_join, packing, pii, quality, ranks, storage, token_store
from gleaner.llm import words as W
from gleaner.llm.tokens import WordMemo

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def encode(path: str, texts: list[str | None], end: int) -> list[list[int]]:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---------------------------------------------------------------- tokens

AWKWARD = [
    "", " ", "\n", "  a  b\n\n c", "a\tb  c", " lead", "trail ", "trail\n", "x y z　q", "Don't stop, it's 12345 we'll", "<|endoftext|> hi <|endoftext|>",
    "É café ́", "\x1ca b", "a\n b", "a \nb", "ΣΣ ΟΣ", "z" * 5000, "one two " * 3000,
]


@pytest.mark.parametrize("path,spaces,by_bytes", [(WORD_BPE, "dropped", False), (WORD_BPE, "dropped", True), (BYTE_BPE, "leading", False)])
def test_memo_encodes_like_the_tokenizer(path, spaces, by_bytes):
    memo = WordMemo(path, spaces, by_bytes)
    for _ in range(2):  # the second time from memory
        ids, n = memo.encode(AWKWARD)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x[:-1] for x in encode(path, AWKWARD, 0)]


def test_merges_by_bytes_give_the_tokenizers_ids(spark, sf_dir):
    assert ranks.by_bytes(WORD_BPE) and not ranks.by_bytes(BYTE_BPE)
    letters = list("abcdefghijklmnopqrstuvwxyzAEORTéèüñß")
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(letters, n)) + str(rng.choice(["", ".", ",", "?!", "..."])) for n in rng.integers(1, 40, 20_000)]
    texts = [" ".join(words[i: i + 50]) for i in range(0, len(words), 50)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(2000).collect()]
    ids, n = WordMemo(WORD_BPE, "dropped", True).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x[:-1] for x in encode(WORD_BPE, texts, 0)]


def test_spaced_words_in_one_call_give_the_tokenizers_ids(spark, sf_dir, monkeypatch):
    assert ranks.spaced_by_bytes(BYTE_BPE) and not ranks.spaced_by_bytes(WORD_BPE)
    letters = list("abcdefghijklmnopqrstuvwxyzAEORTéèüñßÖ")
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(letters, n)) + str(rng.choice(["", ".", ",", "?!", "...", "'s", "7"])) for n in rng.integers(1, 40, 20_000)]
    texts = [" ".join(words[i: i + 50]) + "\nnext" for i in range(0, len(words), 50)] + AWKWARD
    texts += [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(2000).collect()]
    memo, singly = WordMemo(BYTE_BPE, "leading", True), []
    monkeypatch.setattr(memo, "_plain", lambda word: singly.append(word) or WordMemo._plain(memo, word))
    ids, n = memo.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x[:-1] for x in encode(BYTE_BPE, texts, 0)]
    assert not any(w.isascii() and w.isalpha() and len(w) <= 200 for w in singly)  # none is left to be encoded by itself


def test_a_task_gives_its_free_memory_back(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(storage.pa, "default_memory_pool", Pool)
    assert list(storage.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and Pool.released == 1


def test_merges_that_depend_on_more_than_bytes_are_told(tmp_path):
    with open(WORD_BPE, encoding="utf-8") as f:
        tokenizer = json.load(f)
    merges = [m.split(" ") if isinstance(m, str) else m for m in tokenizer["model"]["merges"]]
    made = {a + b: i for i, (a, b) in enumerate(merges)}
    whole = next(i for i, (a, b) in enumerate(merges) if len(a) == 2 and len(b) == 1)
    part = made[merges[whole][0]]
    merges[whole], merges[part] = merges[part], merges[whole]  # a token is merged before its own part
    tokenizer["model"]["merges"] = merges
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(tokenizer), encoding="utf-8")
    assert not ranks.by_bytes(str(path))


def test_packing_is_gapless_and_whole(docs):
    rows = docs.collect()
    want = Counter(tuple(x) for x in encode(WORD_BPE, [r.text for r in rows], 2))
    pieces = packing.pack(docs, WORD_BPE, window=512).toPandas().sort_values(["sequence_id", "offset"])
    stream = np.concatenate([np.frombuffer(x, "<u4") for x in pieces["ids"]]).tolist()
    assert len(stream) == sum(len(k) * n for k, n in want.items())
    for _, one in pieces.groupby("sequence_id"):
        assert one["offset"].tolist() == [0, *np.cumsum(one["length"])[:-1]]
    sizes = pieces.groupby("sequence_id")["length"].sum().tolist()
    assert all(s == 512 for s in sizes[:-1])
    last = int(pieces["sequence_length"].iloc[-1])
    assert last == (sizes[-1] if sizes[-1] & (sizes[-1] - 1) == 0 else 512)
    # documents, put together again from the stream
    got, at = Counter(), 0
    while at < len(stream):
        n = int(pieces["doc_tokens"].iloc[np.searchsorted(np.cumsum(pieces["length"]), at, side="right")])
        got[tuple(stream[at: at + n])] += 1
        at += n
    assert got == want
    whole = packing.sequences(packing.pack(docs, WORD_BPE, window=512)).toPandas()
    assert set(whole["ids"].map(len)) <= {4 * 512, 4 * last}


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, WORD_BPE).count() == 0


def test_token_store_gives_back_every_row(spark, docs):
    rows = docs.collect()
    folder = token_store.write(docs, BYTE_BPE, shards=4)
    got = token_store.read(spark, folder, docs.select("doc_id")).toPandas()
    want = Counter((r.doc_id, crc(x)) for r, x in zip(rows, encode(BYTE_BPE, [r.text for r in rows], 0)))
    key = lambda x: None if x != x or x is None else int(x)
    assert Counter((key(r.doc_id), zlib.crc32(r.ids)) for r in got.itertuples()) == want
    got = got.sort_values("start")
    assert got["start"].tolist() == [0, *np.cumsum(got["n_tokens"])[:-1]]
    ids = [key(x) for x in got["doc_id"]]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    strange = spark.createDataFrame([(99,), (9,), (9,)], "doc_id long")
    assert token_store.read(spark, folder, strange).count() == 1


def test_token_store_of_nothing(spark, nothing, docs):
    folder = token_store.write(nothing, BYTE_BPE)
    assert token_store.read(spark, folder, docs.select("doc_id")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = token_store.key_hash(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    keys = np.unique(keys)
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))


# ---------------------------------------------------------------- n-gram join

def brute_groups(rows, width=5, similarity=0.8):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
        sets.append({tuple(w[i: i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 1000 * len(a & sets[j]) >= round(1000 * similarity) * len(a | sets[j]):
                low[max(root(i), root(j))] = min(root(i), root(j))
    smallest = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            smallest[root(i)] = min(r.doc_id, smallest.get(root(i), r.doc_id))
    return Counter((r.doc_id, len(s), smallest.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets)))


def test_join_on_awkward_rows(docs):
    got = Counter(tuple(r) for r in ngram_join.classes(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_groups(docs.collect())


def test_join_keeps_columns_and_one_of_each_group(docs):
    both = ngram_join.near_duplicates(docs)
    assert both.columns == [*docs.columns, "n_shingles", "component_id"]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter([1, 4, 5, 6, 7, 9, None, None, 10, 11, 12])


def test_one_of_each_group_stays_whatever_its_ids(spark):
    """Groups without any id are reduced to one, and groups that share their smallest id are two."""
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, words), (None, words), (None, words + " more"), (None, "alone here"), (None, ""), (None, ""), (3, other), (3, other), (3, "another text of the same id")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter((r.doc_id, r.text) for r in kept if r.text != words + " more" and r.text != words)
    assert texts == Counter([(None, "alone here"), (None, ""), (None, ""), (3, other), (3, "another text of the same id")])
    assert len(kept) == 6


def test_join_of_nothing(nothing):
    assert ngram_join.classes(nothing).count() == 0
    assert ngram_join.keep_one(nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_chains_and_borderline_copies(spark, seed):
    """A large group of copies with edits around the threshold, chains of copies, and a passage that many texts share."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(5000)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    texts = []
    for _ in range(150):
        t = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 5)):
            t[at] = word()
        texts.append(t)
    for _ in range(100):
        texts.append(passage + [word() for _ in range(rng.integers(1, 60))])
    chain = [word() for _ in range(80)]
    for i in range(20):
        texts.append(chain[i * 3: i * 3 + 40])
    texts += [list(base)] * 5
    order = rng.permutation(len(texts))
    table = spark.createDataFrame([(int(i), " ".join(texts[i])) for i in order], "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.classes(table, fragments=7).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_groups(table.collect())


# ---------------------------------------------------------------- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PRIVATE = [
    "write to a.b@c.org, x@y, a@b.c@d.e or @z.org and q@w.e-r.com.", "at 1.2.3.4.5.6.7.8 or 300.1.1.1 or 001.02.3.255 or 0000000300.1.1.1 and 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4111111111111111!", "call +1 (729) 555-7725 or +12 or +1-2-3-4-5-6-7-8-9 (now)+49 30 1234567",
    "12345678901234567890 1234567890123456", "+4111111111111111", "é 😀 a@b.co 😀 +1 234 567 8901", "a@b", "@", "a@@b.c", "x" * 3000 + "@y.zz",
]


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and (not 12 <= len(digits) <= 19 or sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


@pytest.mark.parametrize("text", PRIVATE)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.matches(text)[0] == brute_spans(text)


def test_spans_and_digests(spark, docs):
    import hashlib

    table = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(100 + i, t, i) for i, t in enumerate(PRIVATE)], "doc_id long, text string, n long"))
    rows = table.collect()
    got = pii.detect(table).collect()
    want = Counter((r.doc_id, hashlib.sha256(pii.joined(brute_spans(r.text or "")).encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        assert len([s for s in r.spans.split(",") if s]) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    assert pii.detect(table.limit(0)).count() == 0


def test_method_adds_spans_and_leaves_decoys(spark):
    rows = [(i, f"mail user{i}@host{i % 7}.org or call +1 (729) 555-{7000 + i}") for i in range(40)]
    rows += [(100 + i, f"order number {4000000000000000 + i * 37} of the year") for i in range(40)]
    rows += [(200, "please call 729-555-7725 today"), (201, "email jane.doe [at] example [dot] com please"), (202, "part 100-200-3000 and look at this dot there")]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200].spans == "phone:12:24" and got[201].spans == "email:6:37"
    assert got[202].spans == ""
    assert all(got[100 + i].n_added == 0 for i in range(40))
    text = spark.createDataFrame([(1, "a@b.co and +1 (729) 555-7725.", 5), (2, None, None)], "doc_id long, text string, n_chars int")
    assert [tuple(r) for r in pii.redact(text).orderBy("doc_id").collect()] == [(1, "<EMAIL> and <PHONE>.", 20), (2, None, None)]


# ---------------------------------------------------------------- models

def test_language_of_held_out_texts(spark, sf_dir, docs, nothing):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id.held_out("doc_id", 3, 1)
    names, bundles = language_id.prototypes(table.filter(~out))
    assert names == ["de", "en", "es", "fr"]
    got = language_id.predict(table, names, bundles).join(table.filter(out).select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    odd = {r.n: (r.lang_pred, r.score) for r in language_id.predict(docs.select(docs.n.alias("doc_id"), "text"), names, bundles).withColumnRenamed("doc_id", "n").collect()}
    assert len(odd) == docs.count() and odd[4] == odd[5] == odd[6] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in odd.values())
    assert language_id.predict(nothing, names, bundles).count() == 0
    names, bundles = language_id.prototypes(nothing)
    assert names == [] and {r.lang_pred for r in language_id.predict(docs, names, bundles).collect()} == {"und"}


def test_scripts_of_many_letters_are_taken_in_slices():
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 4000))), "", "plain words", "123", "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 500)))]
    sums, known = language_id.bundles_of(texts, 700)
    again, _ = language_id.bundles_of(texts, 1 << 20)
    assert (sums == again).all() and known.tolist() == [True, False, True, False, True]
    letters = dict(zip(" plainwords", language_id.letter_vectors(np.array([ord(c) for c in " plainwords"])).astype(int)))
    text = " plain words "
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(text, text[1:], text[2:]))
    assert (sums[2] == want).all()


def test_prototypes_do_not_depend_on_the_split(docs):
    a, b = language_id.prototypes(docs.repartition(1)), language_id.prototypes(docs.repartition(5))
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_quality_of_held_out_texts(spark, sf_dir, docs, nothing):
    big = sf_dir.replace("sf0.001", "sf0.01")
    table, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = language_id.held_out("doc_id", 5, 0)
    stats, model = quality.fit_documents(table, labels, ~out)
    got = quality.scored(stats, model).join(labels, "doc_id").filter(out).toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    again = quality.scored(stats, quality.fit_documents(table, labels, ~out)[1])
    assert again.subtract(quality.scored(stats, model)).count() == 0
    odd = quality.scored(quality.statistics(docs), model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert quality.scored(quality.statistics(nothing), model).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_isotonic_is_the_monotone_least_squares_fit():
    centres, means = quality.isotonic(np.array([6.0, 2, 3, 4, 5, 1]), np.array([1.0, 1, 0, 1, 0, 0]))
    assert centres.tolist() == [1, 3.5, 6] and means.tolist() == [0, 0.5, 1]


# ---------------------------------------------------------------- mixing

def test_targets_share_everything_below_the_cap():
    got = mixing.targets([10, 100, 1000, 0], [1, 2, 3, 1])
    assert abs(sum(got) - 1110) < 1e-9 and got[0] == 30 and got[3] == 0 and got[1] == 300


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_permutations(size):
    got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 9))
    assert sorted(got.tolist()) == list(range(size))


def test_mix_meets_its_targets(spark, sf_dir, docs, nothing):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").union(docs.selectExpr("doc_id", "text", "lang", "source", "n"))
    got = mixing.taken(table).toPandas()
    rows = table.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter(got["size"].tolist()) == Counter(size(r.text) for r in rows)
    assert (got["taken"] <= 3 * got["size"]).all()
    per = {}
    for r in rows:
        per[r.source] = per.get(r.source, 0) + size(r.text)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    want = mixing.targets([per[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])
    sums = got.groupby(["source_size", "target"])["taken"].sum()
    for (n, aim), took in sums.items():
        same = [s for s, t in zip(order, want) if abs(t - aim) < 1e-6 and per[s] == n]
        assert same and abs(took - aim * len(same)) <= 0.02 * aim * len(same) + 2 * len(same)
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert Counter(map(tuple, mixing.taken(table).toPandas()[key].fillna(-1).to_numpy().tolist())) == Counter(map(tuple, got[key].fillna(-1).to_numpy().tolist()))
    assert mixing.taken(nothing).count() == 0


def test_mixed_pieces_are_what_is_taken(docs, nothing):
    table = docs.withColumn("s", docs.n).withColumn("block", docs.n).withColumn("n_chars", docs.n)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    words = Counter()
    for r in mixed.collect():
        words[r.row] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    took = Counter(r.taken for r in mixing.taken(docs).collect() if r.taken)
    assert Counter(words.values()) == took
    assert mixing.mix(nothing.withColumn("n_chars", nothing.n)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 17, 1000])
def test_permutations_can_be_walked_back(size):
    there = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 9))
    assert mixing.permuted(there, np.full(size, size), np.full(size, 9), back=True).tolist() == list(range(size))


def test_slots_of_a_hot_source_are_spread(spark):
    p = mixing.plan([("hot", 90_000_000), ("b", 6_000_000), ("c", 4_000_000)])
    found = mixing.slots(spark, p).withColumn("task", F.spark_partition_id()).toPandas()
    for s in range(3):
        own = found[found["s"] == s].sort_values("slot")
        k = np.arange(p.slots[s])
        assert own["slot"].tolist() == k.tolist()
        want = mixing.permuted(k % p.blocks[s], np.full(len(k), p.blocks[s]), mixing._key(np.full(len(k), s), k // p.blocks[s], p.seed))
        if p.last[s] >= 0:
            want[-1] = mixing.CUT_OFF
        assert own["block"].tolist() == want.tolist()
    hot = found[found["s"] == int(np.argmax(p.slots))].groupby("task").size()
    assert len(hot) > 2 and hot.max() < 0.6 * hot.sum()


def test_small_sources_keep_their_running_text(spark):
    """Sources of every size are cut at the same 256 words, and what is taken of each is its target."""
    rows = []
    for source, n_docs, words in (("a", 30, 10_000), ("b", 7, 700), ("c", 3, 300), ("d", 1, 100), ("e", 1, 1)):
        rows += [(len(rows) + i, " ".join(f"{source}{i}w{k}" for k in range(words)), source) for i in range(n_docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    took = mixing.taken(table).toPandas()
    per = took.groupby("source_size").agg({"target": "first", "taken": "sum"})
    assert (abs(per["taken"] - per["target"]) <= 0.5).all() and len(per) == 5
    before, first = {}, {}
    for i, text, source in rows:
        first[i] = before.get(source, 0)
        before[source] = first[i] + len(text.split())
    words, cut = Counter(), Counter()
    for r in mixing.mix(table).collect():
        piece, whole = r.text.split(), rows[r.doc_id][1].split()
        at = whole.index(piece[0])
        assert whole[at: at + len(piece)] == piece
        words[r.doc_id] += len(piece)
        begin, end = first[r.doc_id] + at, first[r.doc_id] + at + len(piece)
        assert at == 0 or begin % 256 == 0
        cut[r.source] += end % 256 > 0 and at + len(piece) < len(whole)
    assert all(n <= 1 for n in cut.values())
    assert {d: n for d, n in zip(took["doc_id"], took["taken"]) if n} == dict(words)


# ---------------------------------------------------------------- helpers

def test_batches_by_bytes_lose_nothing(docs):
    import pyarrow as pa

    table = docs.toArrow()
    for most in (1, 100, 10_000, 1 << 30):
        parts = list(W.by_bytes(iter(table.to_batches(max_chunksize=4)), "text", most))
        assert pa.concat_tables(parts).select(["n"]).to_pydict() == table.select(["n"]).to_pydict()


def test_columns_of_the_names_that_operators_use(docs):
    """Extra columns named like the operators' own come back with their values."""
    own = {"__row": 700, "__size": 800, "__s": 1, "__block": 2, "__before": 3, "component": 4, "row": 5, "n": 6, "other 1": 7}
    table = docs.withColumns({c: F.lit(v) for c, v in own.items()})
    for found in (ngram_join.keep_one(table), ngram_join.near_duplicates(table), mixing.mix(table)):
        assert set(table.columns) <= set(found.columns)
        assert {tuple(r) for r in found.select(*[f"`{c}`" for c in own]).collect()} == {tuple(own.values())}
    taken = {tuple(r) for r in mixing.taken(docs).collect()}
    assert {tuple(r) for r in mixing.taken(table).collect()} == taken
    one, other = (sorted(map(repr, ngram_join.classes(d).collect())) for d in (docs, table))
    assert one == other
