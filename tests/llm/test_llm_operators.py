"""The text operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import chat, compression_classifier, exact_dedup, minhash, mixing, packing, pii, quality_rules, repeats, warc
from lodestack.llm.shingles import Shingler

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["kept", "component_id", "keep_id", "node", "bucket", "digest", "block", "piece", "_position", "score", "id", "th", "comp", "anchor"]


def frame(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, (sources or {}).get(i, f"s{k % 3}"), None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def words(seed, n, vocabulary=500):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


# exact dedup


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        known = [x for x in groups[n] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = ["a b", "a  b", "a\t\nb", None, "", " ", "a b ", "\u00a0a b", "é" * 50_000, "é" * 50_000, "A b", "a b"]


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_groups(spark, fan_in):
    df = frame(spark, TEXTS, [5, 3, 9, 1, 2, 0, 8, 7, 11, 10, 12, None]).repartition(7)
    assert result(exact_dedup.exact_groups(df, fan_in=fan_in)) == brute_exact([(r.doc_id, r.text) for r in df.collect()])


def test_exact_dedup_keeps_rows_whole(spark):
    df = clashing(frame(spark, TEXTS + ["a b", "z", None, "z"], [5, 3, 9, 1, 2, 0, 8, 7, 11, 10, 12, 4, 3, 20, None, None]))
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 3, 7, 8, 10, 12, 20]
    bare = frame(spark, ["q", "q", "r"], [None, None, None])
    assert sorted(r.text for r in exact_dedup.exact_dedup(bare).collect()) == ["q", "r"]


def test_a_third_of_all_rows_in_one_group(spark):
    df = frame(spark, ["same" if i % 3 == 0 else f"t{i}" for i in range(3000)]).repartition(40)
    kept = [r for r in exact_dedup.exact_groups(df).collect() if r.kept]
    assert len(kept) == 2001


# quality rules


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    r = random.Random(1)
    texts = [None, "", " \n", "é é é é", "\u2003a\u2003", "a b c a b c", "x\nx\n\nx"] + ["".join(r.choice("ab é\n#*|!") for _ in range(r.randrange(200))) for _ in range(200)]
    got = {x.doc_id: tuple(x)[1:6] for x in quality_rules.quality_report(clashing(frame(spark, texts))).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_quality_filter_agrees_with_report_and_order_does_not_matter(spark):
    texts = [" ".join(words(i, 80)) for i in range(150)] + [" ".join(["spam ham eggs"] * 40)] * 40 + ["*** ".join(words(9, 90)), None, ""]
    df = clashing(frame(spark, texts)).repartition(2)
    kept = {r.doc_id for r in quality_rules.quality_report(df).where("kept").collect()}
    backwards = dict(reversed(quality_rules.RULES.items()))
    for rules in (None, backwards):
        out = quality_rules.quality_filter(df, rules=rules)
        assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept
    assert kept == set(range(150))


def test_cascade_orders_by_rejection_per_cost():
    cascade = quality_rules.Cascade({"never": lambda t: False, "always": lambda t: True})
    for _ in range(quality_rules.SAMPLE):
        assert cascade.rejects(quality_rules.Text(b"x"))
    assert cascade.order[0] == "always"


# near duplicates


def brute_near(rows, threshold=75):
    shingle = Shingler()
    sets = {i: set(shingle((t or "").encode()).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted(((i, len(sets[i]), top(i), i == top(i)) for i in ids), key=str)


def near_texts(groups, copies, length=60, edits=9):
    r = random.Random(3)
    out = [None, "", "one two", "ONE two", "one  two", "one two three four five"]
    for g in range(groups):
        base = words(g, length)
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(edits)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**9)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [64, 2])
def test_near_groups(spark, small, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "TILE", 16)
    texts = near_texts(8, 12) + near_texts(1, 60)
    df = frame(spark, texts, random.Random(5).sample(range(1000), len(texts)))
    assert result(minhash.near_groups(df)) == brute_near([(r.doc_id, r.text) for r in df.collect()])


def test_near_dedup_rows(spark):
    df = clashing(frame(spark, ["a b c d e f", "A b c d e f", None, None, "q", "q"], [4, 3, 1, 2, 9, None]))
    out = minhash.near_dedup(df)
    assert out.columns == df.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "2", "3", "9", "None"]


def test_signature_estimate(spark):
    a, b = words(1, 400, 10**6), words(1, 400, 10**6)
    b[:40] = words(7, 40, 10**6)
    sig = minhash.signatures(frame(spark, [" ".join(a), " ".join(b)])).collect()
    x, y = ({f"{k}{j}": r[f"s{j}"] for j in range(4)} for k, r in zip("xy", sig))
    got = spark.createDataFrame([(*x.values(), *y.values())], [*x, *y]).select(minhash._similarity("x", "y")).first()[0]
    p, q = (set(Shingler()(" ".join(w).encode()).tolist()) for w in (a, b))
    assert abs(got - len(p & q) / len(p | q)) < 0.2


# mixing


def test_mixing_deviates_by_less_than_one_block(spark):
    weights = {"a": 5, "b": 3, "c": 1, "d": 2}
    sources = {i: "abcd"[i % 4] for i in range(6000)}
    df = clashing(frame(spark, ["x"] * 6000, sources=sources))
    out = mixing.mixed_order(df, weights).collect()
    total, last = sum(weights.values()), min(max(r.slot for r in out if r.source == s) for s in weights)
    slots = {r.slot: r.source for r in out}
    seen = collections.Counter()
    for t in range(last):
        seen[slots[t]] += 1
        assert all(abs(seen[s] - (t + 1) * q / total) < 1 for s, q in weights.items())


def test_mixing_places_every_row_once(spark):
    df = frame(spark, ["x"] * 500, sources={i: None if i % 3 else f"s{i % 7}" for i in range(500)}).unionByName(frame(spark, ["y", "z"], [None, None]))
    out = mixing.mixed_order(df, {"s1": 4, "s2": 2})
    assert sorted(r.position for r in out.collect()) == list(range(502))
    whole = mixing.mixed(clashing(df), {"s1": 4, "s2": 2})
    assert whole.columns == clashing(df).columns and whole.count() == 502


def test_mixing_refuses_bad_weights(spark):
    with pytest.raises(ValueError):
        mixing.mixed_order(frame(spark, ["x"]), {"s0": 0})
    with pytest.raises(Exception, match="more than 4096"):
        mixing.mixed_order(frame(spark, ["x"]), {"s0": 5000}).collect()


# packing


def test_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = [None, "", "Hello, wörld! it's 12,5 <|endoftext|> <|x|>", "İstanbul Σς \u0301é\u00a0x\u2003y", "word " * 3000, "a'LL b\x1cc\x85d 한글"]
    got = packing.pieces(frame(spark, texts), keep_ids=True).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        mine = [r for r in got if r.doc_id == i]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids
        assert [r.start for r in mine] == list(range(0, len(ids), 2048)) and all(r.length == 2048 for r in mine[:-1])
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in mine)


@pytest.mark.parametrize("per_task", [40_000, 200])
def test_packing_is_whole_and_tight(spark, per_task):
    r = np.random.default_rng(0)
    items = spark.createDataFrame([(None if i % 50 == 0 else i % 300, int(n)) for i, n in enumerate(np.minimum(2048, r.exponential(600, 1500).astype(int) + 1))], "doc_id long, length long")
    out = packing.pack(items, per_task=per_task).collect()
    assert collections.Counter((x.doc_id, x.length) for x in out) == collections.Counter((x.doc_id, x.length) for x in items.collect())
    bins = collections.defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array([x.length for x in out])) * 1.03 + 1


def test_lower_bounds_hold():
    r = np.random.default_rng(1)
    for _ in range(200):
        lengths = r.integers(1, 2049, r.integers(1, 40))
        bins, offsets, n = packing.best_fit_decreasing(lengths)
        assert packing.lower_bound(lengths) <= n
    assert packing.lower_bound(np.array([1100] * 7)) == 7 and packing.lower_bound(np.array([683] * 7)) == 4


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x[-9:]) <= 255 and not x[:-9].strip("0") for x in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def test_pii_base_kinds():
    anchors, r = pii.automaton(), random.Random(2)
    texts = ["".join(r.choice("0011234567895 .-+@aZ()_%é\n://") for _ in range(r.randrange(50))) for _ in range(20_000)]
    texts += ["x 4111 1111 1111 1111, a@b.co", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 (017) 555-7713", "0" * 5000 + ".1.1.1", "a" * 300 + "@" + "b" * 300 + ".com"]
    for t in texts:
        assert [s for s in pii.find(t, anchors) if s[1] < 4] == brute_pii(t), t


def test_pii_added_kinds():
    text = "see https://bob:pw1@host.org/x IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678, token = \"9233A8ECF7C5B09FE594\" and IBAN DE00 3704 0044 0532 0130 00"
    found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text, pii.automaton()) if k >= 4]
    assert found == [("login", "bob:pw1"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("secret", "9233A8ECF7C5B09FE594")]


def test_pii_report_and_redaction(spark):
    df = clashing(frame(spark, [None, "", "mail é a@b.co now", "x" * 100_000 + " 10.0.0.1"]))
    got = {r.doc_id: (r.n_email, r.n_ip, r.spans, r.base_sha256) for r in pii.pii_report(df).collect()}
    assert got[0] == got[1] == (0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][2] == "email:7:13" and got[2][3] == hashlib.sha256(b"email:7:13").hexdigest() and got[3][1] == 1
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[0] is None and out[2] == "mail é [email] now"


# classifier


def test_classifier_separates_and_never_fits_on_held_out(spark):
    texts = [" ".join(words(i, 120)) if i % 4 else "*** ".join(words(i, 120)) for i in range(800)]
    df = clashing(frame(spark, texts + [None, "", "x" * 120_000]))
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(800)] + [(None, 1), (5, None), (99_999, 0)], "doc_id long, quality int")
    got = compression_classifier.quality_scores(df, labels).collect()
    assert len(got) == 803 and all(0 <= r.score <= 1 for r in got) and all(r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 800]
    assert {r.doc_id for r in held} == {i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in held]) > 0.95
    wrong = labels.withColumn("quality", F.when(compression_classifier.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert result(compression_classifier.quality_scores(df, wrong)) == result(compression_classifier.quality_scores(df, labels))


def test_classifier_without_labels(spark):
    df = frame(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in compression_classifier.quality_scores(df, none).collect()] == [0.5, 0.5]


# repeated passages


def brute_repeats(rows, length, keep_first):
    where = collections.defaultdict(list)
    for d, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            where[raw[k : k + length]].append((i, k, d))
    out = []
    for d, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            places = where[raw[k : k + length]]
            if len(places) > 1 and not (keep_first and min(places) == (i, k, d)):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for j in range(len(raw)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_runs", [4096, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats(spark, hot_runs, keep_first, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot_runs)
    r = random.Random(hot_runs)
    pool = ["".join(r.choice("abcdé ") for _ in range(r.randrange(5, 60))) for _ in range(12)]
    texts = [None, "", "ab" * 60, "q" * 90, "q" * 40] + ["".join(r.choice(pool) if r.random() < 0.6 else "".join(r.choice("abcdefgh ") for _ in range(r.randrange(30))) for _ in range(r.randrange(8))) for _ in range(50)]
    got = repeats.without_repeats(clashing(frame(spark, texts)), length=24, gram=8, keep_first=keep_first)
    assert result(got) == brute_repeats(list(enumerate(texts)), 24, keep_first)


def test_suffix_ranks_order():
    raw = np.frombuffer(b"banana" * 20 + b"bandana" * 9, np.uint8)
    starts = np.arange(len(raw) - 24 + 1)
    rank = repeats.suffix_ranks(raw, starts, 24)
    texts = [bytes(raw[s : s + 24]) for s in starts]
    order = {t: k for k, t in enumerate(sorted(set(texts)))}
    assert [order[t] for t in texts] == rank.tolist()


# archives


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 2000
    pages = [(1, "http://a/x?q=1", big), (2, None, big), (3, "http://b\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\n" * 300), (None, "u", big), (7, "u", "d" * 1500), (7, "u", "d" * 1500)]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    folder = f"file://{tmp_path}/w"
    archives = warc.write_warc(df, folder, archive_bytes=20_000, chunk_bytes=1000)
    assert archives.count() > 1
    back = warc.read_warc(archives, folder, chunk_bytes=1000).collect()
    whole = collections.defaultdict(bytes)
    for r in sorted(back, key=lambda r: r.chunk):
        assert len(r.data) <= 1000
        whole[r.page_id] += r.data
    assert whole[2] == big.encode() and whole[1] == b"" and whole[6] == pages[5][2].encode() and whole[3] == b"small"
    last = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back if r.last), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if i in (1, None) else "response", 2 if i in (1, None) else None) for i, _, h in pages]
    assert last == sorted(want, key=str)


def test_warc_of_nothing(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# chat


def test_escapes_are_reversible():
    r = random.Random(4)
    for _ in range(5000):
        t = "".join(r.choice(["<", "|", "\\", ">", "a", "<|im_end|>", "\n"]) for _ in range(r.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "é " * 5000), (1, 0, "user", said), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 5, None, "x"), (None, 0, "user\nx", "<\\|"), (1, 2, "assistant", said)]
    got = {r.conv_id: r for r in chat.chat_report(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ids = chat.format_turns(spark.createDataFrame(rows[1:2], "conv_id long, turn long, role string, text string")).first()
    out = np.frombuffer(ids.ids, "<u4")
    assert (out == chat.START_ID).sum() == 1 and (out == chat.END_ID).sum() == 1 and not any(ids.mask)


# empty tables


def test_empty_tables(spark):
    df = frame(spark, [])
    for f in (exact_dedup.exact_groups, exact_dedup.exact_dedup, quality_rules.quality_report, quality_rules.quality_filter, minhash.near_groups, minhash.near_dedup, mixing.mixed_order, mixing.mixed, packing.packed_documents, pii.pii_report, repeats.without_repeats):
        assert f(df).count() == 0
    assert compression_classifier.quality_scores(df, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert chat.chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


