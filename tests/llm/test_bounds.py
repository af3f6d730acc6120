"""What the operators' steps hold at once, and inputs at the edges of what they take: the largest ids, very long runs, repeated rows, bytes that are no text."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import chat, components, exact_dedup, minhash, mixing, pii, quality_rules, repeats, runtime, warc

from .test_llm_operators import brute_exact, brute_near, brute_quality, clashing, frame, near_texts, result, words

TOP = 2**63 - 1


# exact dedup


@pytest.mark.parametrize("fan_in", [2, 4])
def test_runs_of_few_records_merge_over_many_rounds(spark, fan_in, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 7)
    monkeypatch.setattr(exact_dedup, "_STORE", 2)
    r = random.Random(1)
    texts = [r.choice(["", None, " ", f"t{r.randrange(60)}", f"t\t{r.randrange(60)}"]) for _ in range(400)]
    ids = [r.choice([None, r.randrange(-(2**63), 2**63), TOP, -(2**63)]) for _ in texts]
    df = frame(spark, texts, ids).repartition(9)
    assert result(exact_dedup.exact_groups(df, fan_in=fan_in)) == brute_exact([(row.doc_id, row.text) for row in df.collect()])


def test_the_largest_id_is_an_id(spark):
    out = exact_dedup.exact_groups(frame(spark, ["a"], [TOP])).collect()
    assert [(x.doc_id, x.keep_id, x.kept) for x in out] == [(TOP, TOP, True)]
    assert [x.doc_id for x in exact_dedup.exact_dedup(frame(spark, ["a", "a"], [TOP, None])).collect()] == [TOP]


def _run(*records):
    out = np.zeros(len(records), exact_dedup._RECORD)
    for k, (keys, i, rows, check) in enumerate(records):
        out[k] = (*keys, i or 0, i is not None, rows, 1, check)
    return out


def test_merging_tells_digests_with_one_beginning_apart_and_verifies():
    a, b, c = (5, 1, 0, 0), (5, 2, 0, 0), (2**64 - 1, 0, 0, 0)
    got = exact_dedup.merged([_run((a, 9, 1, 3), (c, None, 2, 4)), _run((a, 4, 2, 3), (b, 1, 1, 8)), _run((b, None, 5, 8), (c, None, 1, 4))])
    assert [(int(x["k0"]), int(x["k1"]), x["id"] if x["known"] else None, x["rows"]) for x in got] == [(5, 1, 4, 3), (5, 2, 1, 6), (2**64 - 1, 0, None, 3)]
    with pytest.raises(ValueError, match="two different texts"):
        exact_dedup.merged([_run((a, 9, 1, 3)), _run((a, 4, 1, 7))])
    with pytest.raises(ValueError, match="power of two"):
        exact_dedup.tree_merge(None, 3)


# near duplicates


def test_blocks_of_tiles_are_bounded_in_shingles_too(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 400)
    texts = near_texts(3, 30) + near_texts(1, 50)
    df = frame(spark, texts, random.Random(6).sample(range(1000), len(texts)))
    assert result(minhash.near_groups(df)) == brute_near([(r.doc_id, r.text) for r in df.collect()])


def test_a_forest_connects_what_the_links_connect():
    r = np.random.default_rng(3)
    for n in (1, 2, 9, 40):
        for _ in range(20):
            link = r.random((n, n)) < 1.2 / n
            link |= link.T
            np.fill_diagonal(link, False)
            i, j = minhash._forest(link)
            assert len(i) < n and link[i, j].all()

            def labels(pairs):
                up = list(range(n))
                for _ in range(n):
                    for a, b in pairs:
                        up[a] = up[b] = min(up[a], up[b])
                return up

            assert labels(list(zip(i.tolist(), j.tolist()))) == labels(np.argwhere(link).tolist())


def test_rows_that_repeat_an_id_and_a_text(spark):
    a = " ".join(words(1, 80))
    df = frame(spark, [a, a, a, a + " more", "x y", "x y"], [4, 4, 4, 7, 9, 9])
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(df).collect())
    assert got == {(4, 4, True): 3, (7, 4, False): 1, (9, 9, True): 2}
    assert sorted(r.doc_id for r in minhash.near_dedup(clashing(df)).collect()) == [4, 9]


def test_a_text_of_another_row_with_the_id_is_never_compared(spark):
    a, b = " ".join(words(1, 80)), " ".join(words(2, 80))
    df = frame(spark, [a, b, a + " more", b + " more"], [4, 4, 7, 8])
    assert {(r.doc_id, r.component_id) for r in minhash.near_groups(df).collect()} == {(4, 4), (7, 4), (8, 4)}
    assert sorted((r.doc_id, r.text) for r in minhash.near_dedup(df).collect()) == sorted([(4, a), (4, b)])


def test_many_long_texts_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 8)
    base = words(1, 4000, 10**6)
    texts = []
    for k in range(40):  # four groups around one text: near within, far between
        r = random.Random(k)
        w = list(base)
        w[: 1000 * (k % 4) // 2] = words(90 + k % 4, 1000 * (k % 4) // 2, 10**6)
        for _ in range(6):
            w[r.randrange(len(w))] = f"e{r.randrange(10**9)}"
        texts.append(" ".join(w))
    df = frame(spark, texts)
    assert result(minhash.near_groups(df)) == brute_near(list(enumerate(texts)))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(60)}


# mixing


def _edf(weights, slots):
    """Earliest deadline first, source by source."""
    total, done, out = sum(w for _, w in weights), [0] * len(weights), []
    for t in range(slots):
        free = [(-(-(done[i] + 1) * total // q), i) for i, (_, q) in enumerate(weights) if done[i] * total // q <= t]
        i = min(free)[1]
        out.append(weights[i][0])
        done[i] += 1
    return out


def test_the_schedule_is_earliest_deadline_first(spark):
    for seed in range(4):
        r = random.Random(seed)
        weights = {f"s{i:02}": r.choice([1, 1, 2, 3, 7, 20]) for i in range(r.randrange(1, 12))}
        counts = spark.createDataFrame([("=" + s, 1) for s in weights], "_source string, _n long")
        got = [row._source[1:] for row in mixing._schedule(counts, weights).orderBy("_slot").collect()]
        assert got == _edf(sorted(weights.items()), sum(weights.values()))


@pytest.mark.parametrize("broadcast", [65_536, 100])
def test_more_sources_than_named_weights_may_add_up_to(spark, broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST", broadcast)
    n = 4500
    df = frame(spark, ["x"] * (n + 200), sources={i: f"s{i % n:04}" for i in range(n + 200)})
    out = mixing.mixed_order(df, {"s0003": 5}).collect()
    assert sorted(r.position for r in out) == list(range(n + 200))
    slots = [(r.slot, r.position) for r in out]
    assert len({r.source for r in out}) == n and sorted(slots) == sorted(slots, key=lambda x: (x[1]))


def test_rows_without_an_id_are_dealt_over_the_cells(spark):
    df = frame(spark, [f"t{i}" for i in range(3000)], [None] * 3000)
    cells = mixing._keyed(df, "doc_id", "source").groupBy("_source", "_cell").count().agg(F.max("count"), F.count("*")).first()
    assert cells[0] <= 12 and cells[1] > 1000
    out = mixing.place(df, {"s0": 3}).select("row.text", "position").collect()
    assert sorted(r.position for r in out) == list(range(3000)) and len({r.text for r in out}) == 3000


# quality rules


def test_the_cascade_charges_features_to_the_rule_that_asks_first():
    rules = quality_rules.RULES
    cascade = quality_rules.Cascade(rules)
    texts = [" ".join(["spam ham eggs"] * 40).encode(), b"few words", " ".join(words(1, 90)).encode(), b"*** " * 60]
    for raw in itertools.islice(itertools.cycle(texts), quality_rules.SAMPLE):
        assert cascade.rejects(quality_rules.Text(raw)) == (raw != texts[2])
    assert cascade.needs["few_words"] == {"words", "n_words"} and "n_repeat_words" in cascade.needs["repeated_words"]
    assert sorted(cascade.order) == sorted(rules) and cascade.cost["n_repeat_words"] > cascade.cost["n_words"]
    fresh = quality_rules.Text(texts[1])
    seen = []
    cascade.rules = {k: (lambda t, k=k, rule=rule: seen.append(k) or rule(t)) for k, rule in rules.items()}
    assert cascade.rejects(fresh) and len(seen) < len(rules) and not rules[seen[0]](quality_rules.Text(texts[2]))
    assert [k for k in seen if rules[k](quality_rules.Text(texts[1]))] == seen[-1:]


def test_order_takes_the_rule_that_rejects_what_is_left():
    rules = {"a": lambda t: t.n_words < 10, "b": lambda t: t.n_words < 9, "c": lambda t: t.n_symbols > 3}
    cascade = quality_rules.Cascade(rules)
    for k in range(quality_rules.SAMPLE):
        cascade.rejects(quality_rules.Text(b"**** " * 40 if k % 2 else b"a b c"))
    cascade.own = dict.fromkeys(rules, 1.0)
    cascade.cost = dict.fromkeys(quality_rules.FEATURES, 0.0)
    order = cascade.ordered()
    assert order[-1] in ("a", "b") and order.index("c") == 1  # b rejects nothing that a leaves


def test_report_and_brute_force_on_long_texts(spark):
    texts = ["a " * 200_000, "x" * 1_000_000, "\n".join(["line of words"] * 5000), "é!! " * 3000, None, ""]
    got = {r.doc_id: (tuple(r)[1:6], r.kept) for r in quality_rules.quality_report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (brute_quality(t), False)


# personal data and chat: bytes that are no text, and long runs


def _raw(spark, values, columns):
    df = spark.createDataFrame(values, columns)
    return df.withColumn("text", F.col("text").cast("string"))


def test_bytes_that_are_not_utf8(spark):
    df = _raw(spark, [(1, bytearray(b"\xff\xfe a@b.co \xc3")), (2, bytearray(b"ok"))], "doc_id long, text binary")
    got = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    assert got == {1: "email:3:9", 2: ""}
    assert {r.doc_id: r.text for r in pii.redact(df).select("doc_id", "text").collect()}[1] == "�� [email] �"
    talk = _raw(spark, [(1, 0, "assistant", bytearray(b"\xffa"))], "conv_id long, turn long, role string, text binary")
    r = chat.chat_report(talk).first()
    assert r.loss_chars == 2 and r.loss_sha256 == hashlib.sha256("�a".encode()).hexdigest()


RUNS = [" ", "\n", "\t", " ", "　", "a", "1", "!", "é", "\\", "<", "|", "\x1c", "字", "<|", "<\\|", " a", "\r\n"]


def test_runs_are_encoded_as_the_tokenizer_does():
    path = chat.vocabulary_path()
    mine, plain = chat.encoder(path), chat.encoding(path).encode_ordinary
    r = random.Random(7)
    for c in RUNS[:5] + [" \n", " \t "]:
        for before, after in (("", ""), ("x", ""), ("", "x"), ("a1", "b"), ("é", "!"), ("'", "'s")):
            text = before + c * 2500 + after
            assert mine(text) == plain(text)
    for _ in range(60):
        text = "".join(r.choice([" " * 2100, "\n" * 2000, "\t " * 1200, "word", " ", "'ll", "12", " ", "!?"]) for _ in range(r.randrange(9)))
        assert mine(text) == plain(text)


@pytest.mark.parametrize("size", [1_000_000, 10_000_000])
def test_chat_of_long_runs(spark, size):
    runs = RUNS if size == 1_000_000 else [" ", "a", "<|"]
    rows = [(k, 0, "assistant", (c * size)[:size]) for k, c in enumerate(runs)]
    got = {r.conv_id: r for r in chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    for k, _, _, text in rows:
        assert (got[k].loss_chars, got[k].loss_sha256, got[k].n_turns) == (size, hashlib.sha256(text.encode()).hexdigest(), 1)
        assert got[k].formatted_chars == len(chat.START) + len("assistant\n") + len(chat.escape(text)) + len(chat.END) + 1


@pytest.mark.parametrize("part", [1, 3, 50, 1 << 16])
def test_conversations_are_read_back_from_parts_of_any_length(spark, part, monkeypatch):
    monkeypatch.setattr(chat, "PART", part)
    r = random.Random(part)
    tokens = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "é", "字", "a b", "\n", "", "<\\\\|"]
    rows = [(c, t, r.choice(["user", "assistant", "a\nb", "", "<|x"]), "".join(r.choice(tokens) for _ in range(r.randrange(9)))) for c in range(12) for t in range(r.randrange(1, 6))]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = runtime.materialise(chat.conversations_of(turns), "parts")
    lengths = [(x.conv_id, x.part, len(x.mask), len(x.ids)) for x in parts.collect()]
    assert all(n <= part and 4 * n == m for _, _, n, m in lengths)
    got = {x.conv_id: x for x in chat.read_back(parts).collect()}
    for c in range(12):
        mine = sorted((t, role, text) for conv, t, role, text in rows if conv == c)
        loss = "".join(x for _, role, x in mine if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, role, x in mine)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reading_refuses_broken_turns():
    tokens = chat.encoding(chat.vocabulary_path())

    def feed(ids):
        reading = chat._Reading(tokens.decode_bytes)
        reading.feed(np.array(ids, np.uint32), np.zeros(len(ids), bool))
        return reading.row()

    role = tokens.encode_ordinary("user\n")
    assert feed([chat.START_ID, *role, chat.END_ID])[0] == 1
    for ids in ([chat.START_ID, *role], [chat.START_ID, chat.START_ID], [chat.END_ID], [chat.START_ID, chat.END_ID]):
        with pytest.raises(ValueError):
            feed(ids)


# repeated passages


def brute_factors(raw, starts, position, length):
    def common(a, b):
        k = 0
        while k < length and raw[a + k] == raw[b + k]:
            k += 1
        return k

    return [max((common(s, t) for t, q in zip(starts, position) if q < p), default=0) for s, p in zip(starts, position)]


def test_previous_factors_against_brute_force():
    r = np.random.default_rng(5)
    for _ in range(60):
        length, n = int(r.integers(8, 40)), int(r.integers(60, 160))
        raw = r.integers(97, 97 + r.integers(1, 4), n).astype(np.uint8)
        if r.random() < 0.5:
            raw[n // 2 :] = raw[: n - n // 2]
        starts = np.arange(n - length + 1)
        position = r.permutation(len(starts))
        levels = repeats._doubled(raw, length)
        order = np.argsort(repeats._final(levels, starts, length), kind="stable")
        lcp = np.zeros(len(order), np.int64)
        lcp[1:] = repeats.common_prefixes(levels, raw, starts[order[:-1]], starts[order[1:]], length)
        factor, where = repeats.previous_factors(position[order], lcp)
        want = brute_factors(raw.tolist(), starts.tolist(), position.tolist(), length)
        assert factor[position].tolist() == want
        assert all(w < p for p, w in enumerate(where.tolist())) and ((where < 0) == (factor == 0)).all()


def test_long_chains_of_smaller_positions():
    position = np.concatenate([np.arange(1, 5001), [0]])
    to, _ = repeats._smaller(position, np.ones(5001, np.int64))
    assert to.tolist() == [*range(-1, 4999), -1]


@pytest.mark.parametrize("keep_first", [False, True])
def test_one_run_of_many_windows_under_a_hot_anchor(spark, keep_first, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_RUNS", 1)
    monkeypatch.setattr(repeats, "_STRETCH", 64)
    texts = ["z" * 3000, "q" * 700, "q" * 701 + "r", None]
    got = sorted(repeats.without_repeats(frame(spark, texts), length=24, gram=8, keep_first=keep_first).collect())
    # with the first copy kept, of z only the windows after the first go: all but its first byte
    assert [r.n_removed for r in got] == ([3000 - 1, 700 - 1, 701, 0] if keep_first else [3000, 700, 701, 0])


# archives


def test_archives_are_read_back_by_a_task_each(spark, tmp_path):
    pages = [(i, "u", f"page {i} " * 300) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    archives = warc.write_warc(df, folder, archive_bytes=10_000)
    n = archives.count()
    back = warc.read_warc(archives, folder, with_data=False)
    assert n > 5 and back.rdd.getNumPartitions() >= n
    assert back.where("last").count() == 60


def test_a_row_that_is_there_very_often(spark):
    df = spark.createDataFrame([(1, "u", "x" * 2000)] * 30_000, "page_id long, url string, html string").repartition(3)
    out = warc.warc_round_trip(df).groupBy("page_id", "payload_bytes", "record_type").count().collect()
    assert [tuple(r) for r in out] == [(1, 2000, "response", 30_000)]


# shared storage


def test_stored_tables_go_when_they_are_dropped(spark):
    kept = runtime.materialise(spark.range(5), "kept")
    gone = runtime.materialise(kept.selectExpr("id + 1 as id"), "gone", batch_rows=2)
    assert gone.count() == 5
    runtime.dropped(gone)
    assert kept.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(gone._stored_at).count()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_dir(Session())


def test_words_of_patterns_are_the_same_everywhere():
    text = "a\x1cb\x85c d\x0be f"
    assert re.findall(r"[^\x20\x09-\x0D]+", text) == [w.decode() for w in text.encode().split()]


def test_what_led_to_a_settled_table_goes(spark):
    seen = []

    def make():
        seen.append(runtime.materialise(spark.range(7), "step"))
        return seen[0].selectExpr("id * 2 as id")

    out = runtime.settled(make, "result")
    assert out.count() == 7 and not runtime._MADE
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(seen[0]._stored_at).count()
