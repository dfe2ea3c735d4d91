"""Corpus operators over documents and conversations against plain versions, with the edge cases of each."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofgraph.llm import chat, common, cotraining, langid, mixing, ngram_join, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def plain_components(rows, width=5):
    def shingles(text):
        words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())

    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def near_copies(seed, groups=12, size=8):
    draw, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice([3, 5, 8, 40, 120, 400]))]
        for _ in range(draw.randrange(1, size)):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                words[draw.randrange(len(words))] = f"x{draw.randrange(9)}"
            rows.append(" ".join(words).upper() if draw.random() < 0.2 else "\n".join(words))
    draw.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_matches_brute_force(spark, seed):
    rows = near_copies(seed) + [(90001, None), (90002, ""), (90003, " \t\n"), (90004, "One two"), (90005, "one TWO"), (90006, "a " * 3000), (90007, "a " * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "digest", "rep", "node", "component", "part")})
    found = ngram_join.jaccard_components(frame).collect()
    assert {tuple(r) for r in found} == plain_components(rows)
    assert len(found) == len(rows)


def test_ngram_join_repeated_rows_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(frame).collect()), key=str) == sorted([(1, 2, 0), (1, 2, 0), (None, 2, 0), (0, 2, 0)], key=str)
    assert ngram_join.jaccard_components(frame.limit(0)).count() == 0


def test_prefix_tree_equals_all_pairs():
    draw = np.random.default_rng(3)
    for _ in range(60):
        base = np.unique(draw.integers(0, 60, 25).astype(np.uint64))
        sets = [np.unique(np.concatenate((draw.choice(base, draw.integers(1, len(base)), replace=False), draw.integers(0, 80, 2).astype(np.uint64)))) for _ in range(draw.integers(2, 14))]
        tree = ngram_join.PrefixTree(sets)
        linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 180 * len(np.intersect1d(a, b)) >= 80 * (len(a) + len(b))}
        assert {(i, j) for i, a in enumerate(sets) for j in tree.links(a).tolist()} == linked
        left, right = np.array(ngram_join.tree_links(sets) or np.empty((0, 2)), np.int64).reshape(-1, 2).T
        whole = np.array([p for p in linked]).reshape(-1, 2).T
        assert common.local_roots(len(sets), left, right).tolist() == common.local_roots(len(sets), *whole).tolist()


def test_large_groups_are_split_and_salted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    members, sizes = np.arange(11, dtype=np.uint64), np.full(11, 5)
    pairs = {(a, b) for g in ngram_join.blocks_of(members, sizes) for a in g.tolist() for b in g.tolist()}
    assert pairs == {(a, b) for a in range(11) for b in range(11)}
    digest = np.random.default_rng(0).integers(0, 1 << 60, 9).astype(np.uint64)
    token, row, _ = ngram_join.salted(np.full(9, 5, np.uint64), np.arange(9), np.zeros(9, np.int64), np.full(9, 3), digest)
    met = defaultdict(set)
    for t, r in zip(token.tolist(), row.tolist(), strict=True):
        met[t].add(r)
    assert all(any({a, b} <= m for m in met.values()) for a in range(9) for b in range(9))


def test_partners_are_those_that_fit():
    draw = np.random.default_rng(8)
    for _ in range(300):
        n = draw.integers(1, 40, draw.integers(1, 30))
        place = np.array([draw.integers(0, k) for k in n])
        plain = [any(i != j and ngram_join.fit(n[i], place[i], n[j], place[j], 80) for j in range(len(n))) for i in range(len(n))]
        assert ngram_join.has_partner(n, place).tolist() == plain


@pytest.mark.parametrize("probes", [0, 2])
def test_large_clusters_are_cut_into_blocks_and_lose_no_link(spark, monkeypatch, probes):
    monkeypatch.setattr(ngram_join, "CLUSTER_BLOCK", 6)
    monkeypatch.setattr(ngram_join, "PROBES", probes)
    draw, rows = random.Random(6), []
    for g in range(3):  # chains: each text is the one before with some words changed, so ends don't link
        words = [f"g{g}w{k}" for k in range(150)]
        for k in range(50):
            for _ in range(3):
                words[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    draw.shuffle(rows)
    found = {tuple(r) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_components(rows)


def test_frequent_over_all_tasks_is_found(spark):
    """A shingle in one set a task is in no task's own list, but in the sample of all."""
    rows = [(i, f"one two three four five {' '.join(f'w{i}x{k}' for k in range(12))}") for i in range(6000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(64)
    hints = texts.mapInArrow(ngram_join._profile(5), ngram_join._PROFILE).filter("drawn IS NOT NULL").groupBy("token").agg(F.sum("drawn").alias("n"))
    assert hints.agg(F.max("n")).first()[0] >= ngram_join.HOT_IN_SAMPLE and hints.filter("n > 1").count() <= 3


def test_counting_shingles_of_a_task_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    draw = np.random.default_rng(7)
    common = " ".join(f"c{k}" for k in range(50))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(range(at, at + 20)), pa.array([f"{common} " + " ".join(map(str, draw.integers(1 << 40, size=4000))) for _ in range(20)])], names=["doc_id", "text"])
        for at in range(0, 600, 20)
    ]
    tracemalloc.start()
    try:
        rows = [b for b in ngram_join._profile(5)(iter(batches))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    counted = [d for b in rows for d in b["docs"].to_pylist() if d is not None]
    assert counted == [600] * 46  # the shingles of the common passage, none of the 2.4 million others
    assert peak < 120 << 20  # 12 bytes a shingle, twice while more are put in between


def test_counts_of_shingles_over_several_gatherings():
    token, total, every = np.empty(0, np.uint64), np.empty(0, np.int32), []
    draw = np.random.default_rng(3)
    for size in (0, 5, 300, 0, 2000):
        seen = [draw.integers(400, size=size).astype(np.uint64) for _ in range(2)]
        every += seen
        token, total = ngram_join.added(token, total, list(seen))
        plain = np.unique(np.concatenate(every), return_counts=True)
        assert np.array_equal(token, plain[0]) and np.array_equal(total, plain[1])


def test_histograms_never_exclude_linked_sets():
    draw = np.random.default_rng(5)
    for _ in range(40):
        a = np.unique(draw.integers(0, 1 << 63, draw.integers(5, 900)).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[draw.random(len(a)) < 0.93], draw.integers(0, 1 << 63, len(a) // 30).astype(np.uint64) * np.uint64(2))))
        linked = 180 * len(np.intersect1d(a, b)) >= 80 * (len(a) + len(b))
        i, _ = ngram_join.may_link(np.array([len(a), len(b)]), ngram_join.histograms(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])))
        assert len(i) or not linked


def test_components_match_union_find(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)]
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    roots = common.local_roots(400, *np.array(edges).T)
    assert found == {n: int(roots[n]) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "u long, v long")
    assert {r.component for r in common.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        common.components(chain, max_rounds=2)


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master, getConf = "spark://somewhere", lambda self: {}

    class Session:
        conf, sparkContext = {}, Context()
    with pytest.raises(ValueError):
        common.shared_dir(Session())


def digests(turns):
    text, loss = "", ""
    for role, t in turns:
        text += f"{role}\n{t}\n"
        loss += t if role == "assistant" else ""
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    draw, rows, pieces = random.Random(6), [], ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\\\INST]", "<<SYS>>", "é", "\n", "ok ", "<", "s>", "💡"]
    for conv in range(40):
        for turn in range(draw.randrange(1, 6)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "[INST]\n"]), "".join(draw.choice(pieces) for _ in range(draw.randrange(12)))))
    rows += [(50, 0, None, None), (50, None, "assistant", "first"), (51, 0, "assistant", "x" * 300_000 + "</s>"), (52, 1, "user", "b"), (52, 1, "user", "a"), (52, 1, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit(1))
    wanted = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        wanted[conv].append((role or "", text or ""))
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert found == {c: digests(t) for c, t in wanted.items()}
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_chat_escapes_every_control_string():
    for text in (b"</s>", b"a<s>b[INST]", b"<\\s>", b"[/INST][\\INST]", b"<<SYS>><</SYS>>", b"\\"):
        safe = chat.escape(text)
        assert not re.search(rb"</?s>|\[/?INST\]|<</?SYS>>", safe) and chat.unescape(safe) == text


def test_mixing_reaches_targets(spark):
    draw = random.Random(7)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 7, 90])), "en", draw.choice(["a", "b", "c", "d", None])) for i in range(400)] + [(999, None, None, "a"), (1000, "w " * 20_000, "en", "e")]
    found = mixing.mix(docs_frame(spark, rows).withColumn("taken", F.lit(0))).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in found)
    sums, sizes, targets = defaultdict(int), defaultdict(int), {}
    for r in found:
        sums[r.source] += r.taken
        sizes[r.source] += r.size
        targets[r.source] = r.target
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, left, open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), set(order)
    plain = {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            break
        for s in full:
            plain[s] = 2.0 * sizes[s]
            left -= plain[s]
        open_ -= full
    plain |= {s: weight[s] * level for s in open_}
    assert targets == pytest.approx(plain) and all(abs(sums[s] - targets[s]) <= 1 for s in sums)
    again = mixing.mix(docs_frame(spark, rows[::-1])).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)
    assert mixing.mix(docs_frame(spark, rows[:0])).count() == 0


def test_mixed_documents_have_the_words_taken(spark):
    rows = [(i, f"a{i}  b\nc d\te", "en", "xyz"[i % 3]) for i in range(60)] + [(100, None, None, None), (101, "", "en", "x"), (None, "p q r", "en", "z")]
    frame = docs_frame(spark, rows).withColumn("size", F.lit("clash"))
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(frame).collect()}
    words = defaultdict(int)
    for r in mixing.mixed_documents(frame).collect():
        assert r.size == "clash" and r.n_chars == len(r.text or "")
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {k: v for k, v in words.items() if v} == {k: t for k, (_, t) in taken.items() if t}


def test_packing_invariants_and_best_fit(spark):
    draw = random.Random(8)
    rows = [(i, " ".join([f"w{i % 37}"] * draw.choice([0, 3, 40, 70, 100, 230])), "en", draw.choice("abcdefghij")) for i in range(300)] + [(900, None, None, None), (901, None, None, None)]
    found = packing.pack(docs_frame(spark, rows).withColumn("bin", F.lit(1)), capacity=100).collect()
    bins, sizes = defaultdict(list), defaultdict(int)
    for r in found:
        bins[r.shard, r.bin].append(r)
        sizes[r.doc_id] += r.words
    assert sizes == {i: len((t or "").split()) for i, t, _, _ in rows}
    for held in bins.values():
        assert sum(r.words for r in held) <= 100 and len({r.source for r in held}) == len({r.cluster for r in held}) == len(held)
        at = 0
        for r in sorted(held, key=lambda r: (r.start, r.words)):
            assert r.start == at
            at += r.words
    naive: list[list] = []
    for r in sorted(found, key=lambda r: (-r.words, r.doc_id, r.piece)):
        fits = [(100 - sum(x.words for x in b), k) for k, b in enumerate(naive) if sum(x.words for x in b) + r.words <= 100 and all(x.source != r.source and x.cluster != r.cluster for x in b)]
        where = min(fits)[1] if fits else len(naive)
        if not fits:
            naive.append([])
        naive[where].append(r)
        assert r.bin == where
    assert packing.pack(docs_frame(spark, rows[:0])).count() == 0


def test_packing_edges(spark):
    rows = [(None, f"w{k} x", "en", "s") for k in range(60)] + [(1, "a b", "en", "t")] * 3 + [(2, "w " * 5000, "en", "u"), (3, "near", "en", "v"), (4, "nearly", "en", "w")]
    frame = docs_frame(spark, rows).withColumn("near", F.when(F.col("doc_id") >= 3, 7).otherwise(F.monotonically_increasing_id() + 100))
    found = packing.pack(frame, capacity=100, shard_words=500, cluster="near").collect()
    assert len({r.shard for r in found if r.doc_id is None}) > 3  # rows without doc_id are spread
    assert sum(r.words for r in found if r.doc_id == 2) == 5000 and [r.words for r in found if r.doc_id == 1] == [2] * 3
    bins = defaultdict(list)
    for r in found:
        bins[r.shard, r.bin].append(r)
    assert all(len({r.cluster for r in b}) == len({r.source for r in b}) == len(b) for b in bins.values())
    whole = packing.pack(frame, cluster="near").collect()
    assert {r.doc_id: r.bin for r in whole}[3] != {r.doc_id: r.bin for r in whole}[4]  # one cluster, two bins


PROSE = {"aa": "the and with from this that over under", "bb": "der die das und mit von nicht auf", "cc": "le la les des une dans avec pour"}


def test_language_held_out_accuracy_and_edges(spark):
    draw, rows = random.Random(9), []
    for i in range(400):
        lang = draw.choice(sorted(PROSE))
        rows.append((i, " ".join(draw.choice(PROSE[lang].split()) for _ in range(draw.randrange(4, 60))), lang, "s"))
    rows += [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "123 !?", "aa", "s"), (1003, "THE AND WITH " * 5000, None, "s"), (0, rows[0][1], rows[0][2], "s")]
    frame = docs_frame(spark, rows).withColumns({"score": F.lit(1), "bits": F.lit(2)})
    model = langid.train(frame)
    found = {(r.doc_id, r.lang_pred): r for r in langid.identify(frame, model).collect()}
    truth = {i: lang for i, _, lang, _ in rows if i < 400}
    held = [r for r in found.values() if r.held_out and r.doc_id in truth]
    assert held and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {d for d, lang in found if lang == "und"} == {1000, 1001, 1002} and (1003, "aa") in found
    assert langid.keep_identified(frame).columns == frame.columns
    assert {r.doc_id for r in langid.keep_identified(frame).collect()} >= set(truth)
    empty = frame.limit(0)
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(frame, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(k, f"l{k % 250:03d}".translate(str.maketrans("0123456789", "abcdefghij")) * 6 + f" q{k}", f"lang{k % 250}", "s") for k in range(3000)]
    model = langid.train(docs_frame(spark, rows))
    assert len(model.languages) == 250 and model.landmarks.shape[1] == 500
    found = langid.identify(docs_frame(spark, rows), model).collect()
    assert np.mean([r.lang_pred == f"lang{r.doc_id % 250}" for r in found]) >= 0.9


def test_language_query_matches_plain_kernels(spark):
    """Every document of the small table, its n-grams counted one by one, against the query."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    landmarks, weights = model.landmarks.astype(float), model.weights.astype(float)
    found = {r.doc_id: r for r in langid.op6_language(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        letters = [b if b >= 128 or 97 <= b <= 122 else 32 for b in r.text.lower().encode()]
        places = set()
        for order in (1, 2, 3):
            for k in range(len(letters) - order + 1):
                code = 0
                for b in letters[k:k + order]:
                    code = (code * 257 + b) % 2**32
                places.add((code + order) * 2654435761 % 2**32 >> 19)
        kernel = landmarks[sorted(places)].sum(0) / len(places) ** 0.5
        value = kernel @ weights[:-1] + weights[-1]
        assert model.languages[int(value.argmax())] == found[r.doc_id].lang_pred
        assert abs(min(1.0, max(0.0, (value.max() + 1) / 2)) - found[r.doc_id].score) < 1e-4


def test_language_stage_rejects_lettered_text_of_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(12)
    noise = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 9))) for _ in range(60))
    other = ["Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί", "日本語の文章はここにあります。猫が好きです。", "xq zjw kvp qqx wzz jkh vbx pqz xxk zwq jvk qhx", noise]
    odd = docs_frame(spark, [(10**9 + k, t, None, "s") for k, t in enumerate(other)])
    kept = {r.doc_id for r in langid.keep_identified(docs.select("doc_id", "text", "lang", "source").union(odd.select("doc_id", "text", "lang", "source"))).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_cotraining_separates_and_keeps_edges(spark):
    draw, rows, labels = random.Random(10), [], []
    for i in range(500):
        good = draw.random() < 0.8
        words = [f"{draw.choice('abcdefgh')}{draw.randrange(50)}" for _ in range(draw.randrange(20, 80))]
        rows.append((i, " ".join(w if good else w + draw.choice(["***", "$$$"]) for w in words), "en", "good" if good and draw.random() < 0.9 else "mixed"))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(900, None, None, None), (901, "", "en", "good"), (902, "x " * 50_000, "en", "good")]
    labels += [(None, 1), (3, None), (12345, 0)]
    frame, given = docs_frame(spark, rows).withColumns({"slots": F.lit("clash"), "score": F.lit(1)}), spark.createDataFrame(labels, "doc_id long, quality int")
    model = cotraining.train(frame, given)
    found = {r.doc_id: r for r in cotraining.score(frame, model).collect()}
    truth = {i: "*" not in t and "$" not in t for i, t, _, _ in rows if i < 500}
    unseen = [i for i in truth if i % 2 == 0]
    assert np.mean([found[i].keep == truth[i] for i in unseen]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found.values()) and len(found) == len(rows)
    kept = cotraining.keep_good(frame, given)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.keep}
    assert cotraining.train(frame, given.limit(0)) is None
    assert {r.score for r in cotraining.score(frame, None).collect()} == {0.5}
    assert cotraining.score(frame.limit(0), model).count() == 0


def test_quality_query_matches_plain_views(spark):
    """Every document of the small table, its features counted one by one and its two views combined, against the query."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = cotraining.train(docs, labels)
    slots = {r.doc_id: r.slots for r in docs.select("doc_id", cotraining.meta_slots().alias("slots")).collect()}
    found = {r.doc_id: r for r in cotraining.op3_quality(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == docs.count()
    odds = lambda x: 1 / (1 + np.exp(-x))
    for r in docs.collect():
        data, words = (r.text or "").encode(), WORD.findall((r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        view = np.zeros(cotraining.TEXT_WIDTH)
        if data:
            for b in data:
                view[b] += 1 / len(data)
            view[:256] = np.sqrt(view[:256])
            shingles = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
            n = max(len(words), 1)
            view[256:] = len(set(words)) / n, len(shingles) / max(len(words) - 4, 1), sum(a == b for a, b in zip(words, words[1:])) / n, np.log1p(len(words)) / 10, len(data) / n / 20
        text = ((view - model.text_scale[0]) / model.text_scale[1]) @ model.text[:-1] + model.text[-1]
        meta = sum(model.meta[k] for k in slots[r.doc_id]) + model.meta[-1]
        views = [c[0] * v + c[1] for c, v in zip(model.calibration, (text, meta))]
        both = np.clip(views, -30, 30) @ model.combination[:2] + model.combination[2]
        row = found[r.doc_id]
        assert np.allclose([row.text_score, row.page_score, row.score], [odds(np.clip(views[0], -30, 30)), odds(np.clip(views[1], -30, 30)), odds(both)], atol=2e-3)
        assert row.keep == (row.score >= 0.5)


def test_cotraining_of_repeated_rows(spark):
    rows = [(k % 40, f"good words number {k}" if k % 2 else "*** $$$ ***", "en", "s") for k in range(400)]
    frame = docs_frame(spark, rows + [(1, "good words", "en", "s")] * 500)
    model = cotraining.train(frame, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int"))
    assert cotraining.score(frame, model).count() == 900


def test_pipeline_loses_no_text_and_keeps_no_copy_where_doc_ids_repeat(spark, tmp_path):
    import corpus_pipeline

    t, u = "a common text of seven words here", "quite another one that nobody else has"
    rows = [(1, t, "en", "s"), (1, t, "en", "s"), (2, t, "en", "s"), (5, u, "en", "s"), (5, t, "en", "s"), (None, t, "en", "s"), (None, "one more of its own without number", None, None), (None, None, "en", "s"), (7, "", "en", "s")]
    frame = docs_frame(spark, rows).withColumns({c: F.lit(1) for c in ("component_id", "draw", "slots", "row")})
    kept = corpus_pipeline.near_duplicates(spark, frame, str(tmp_path))
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, t), (5, u), (None, rows[6][1]), (None, None), (7, "")], key=str)
    labels = spark.createDataFrame([(5, 1), (1, 0)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
        stage(spark, frame, str(tmp_path)).count()
    mixed = mixing.mixed_documents(docs_frame(spark, [(1, "a b c d", "en", "s")] * 9 + [(2, "x " * 100, "en", "t")])).filter("doc_id = 1")
    assert 53 - 9 <= mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0] <= 72  # equal rows share what is due


def test_pipeline_stages_keep_their_promises(spark, tmp_path):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.materialize(stage(spark, now, str(tmp_path)), name)
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    assert seen["language"].count() == docs.count()
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert len(good & kept) >= 0.97 * len(good)
    rows = [(r.doc_id, r.text) for r in seen["quality"].collect()]
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {c for _, _, c in plain_components(rows)}
    words = lambda df: df.select(F.coalesce(F.sum(F.regexp_count("text", F.lit(common.WORD_PATTERN))), F.lit(0))).first()[0]
    assert seen["packing"].agg(F.sum("words")).first()[0] == words(seen["mixing"])
    assert abs(words(seen["mixing"]) - 1.5 * words(seen["near_duplicates"])) < 20
