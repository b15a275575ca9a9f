"""Secrets, chats, shards and pseudonyms against brute force; no Python in their plans."""

import hashlib
import random
import re
import zlib

import check
import pytest
from pyspark.sql import functions as F

from crawlkit.llm import chat, pii, queries, secrets, shards

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_secrets", "op4_chat", "op7_shards", "op9_pii"])
def test_native(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", text.replace("ArrowColumnar", "")), text


# --- secrets


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32])


def digest(spans):
    names = ("assign", "access", "hex", "random")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def random_spans(text, ratios, base, least=16, total=12.0, mean=0.5):
    code = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % least, text or ""):
        v = m.group()
        score = sum(ratios[code[a] * secrets.WIDTH + code[b]] for a, b in zip(v, v[1:]))
        if score >= total and score >= mean * len(v) and not any(a < m.end() and m.start() < b for a, _, b in base):
            out.append((m.start(), 3, m.end()))
    return out


def test_secrets_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ratios = secrets.train(secrets.samples(docs))
    got = {r["doc_id"]: r for r in queries.op1_secrets(spark, SF).collect()}
    found = 0
    for doc, text in docs.collect():
        base, r = base_spans(text), got[doc]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(digest(base).encode()).hexdigest()
        assert r["spans"] == digest(base + random_spans(text, ratios, base))
        found += len(base)
    assert found > 0


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    sixty = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["the", "ing", "con", "ter", "ment", "per", "tion", "al", "re", "in", "an"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(6))
    train = [" ".join([word() for _ in range(40)]) + f" password={draw(sixty, 24)}" for _ in range(60)]
    tests = [f"é {word()} {word()} {draw(sixty, 32)} {word()}_{word()}" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(train + tests)), "doc_id long, text string")
    out = secrets.find_secrets(docs, secrets.train(secrets.samples(docs)))
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in out.collect()}
    for i, text in enumerate(tests, len(train)):
        at = text.split(" ")
        start = len(" ".join(at[:3])) + 1
        assert spans[i] == [(start, 3, start + 32)], (text, spans[i])


def test_secret_edges(spark):
    texts = [None, "", "password=short token: 'abcdefgh.i'", "SECRET = x" + "y" * 20_000, "AKIA" + "A" * 11, "AKIA" + "A" * 12,
             "é\U0001f600 api_key=\"ABCDEFGH\" apikey:12345678", "secret:token : abcdefghij", "0" * 31 + " " + "f" * 32, "password==abcdefg",
             " ".join(["token=abcdefgh"] * 3000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, t int")
    out = secrets.find_secrets(docs, [0.0] * secrets.WIDTH**2)
    assert set(out.columns) == {"doc_id", "text", "t", "spans"}
    for r in out.collect():
        assert [tuple(s) for s in r["spans"]] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]
    empty = docs.limit(0)
    assert secrets.find_secrets(empty, secrets.train(secrets.samples(empty))).count() == 0


# --- chats


def test_chat_query_equals_sql(spark):
    assert check.compare(spark, check.connect(SF), "op4_chat", SF).startswith("ok")


def test_fold(spark):
    events = [
        ("c", 1, "m1", "message", "user", "hi"), ("c", 2, "m2", "delta", "assistant", "He"), ("c", 3, "m2", "delta", None, "llo"),
        ("c", 9, "m1", "edit", "user", "Hi!"), ("c", 4, "m3", "delta", "assistant", "bad"), ("c", 5, "m3", "regenerate", None, None),
        ("c", 6, "m3", "delta", None, "good"), ("c", 7, "m3", "delta", None, None), ("d", None, None, None, None, None),
        (None, 1, "m", "odd", "user", "x"), ("e", 1, "m", "message", "user", "a"), ("e", 1, "m", "message", "user", "a"),
    ]
    df = spark.createDataFrame(events, "conv_id string, seq long, msg string, kind string, role string, text string")
    got = sorted(((r["conv_id"], r["seq"], r["role"], r["text"]) for r in chat.fold(df).collect()), key=str)
    assert got == sorted(
        [("c", 1, "user", "Hi!"), ("c", 2, "assistant", "Hello"), ("c", 4, "assistant", "good"), ("d", None, None, ""),
         (None, 1, "user", "x"), ("e", 1, "user", "a"), ("e", 1, "user", "a")], key=str)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_control_strings_survive(spark):
    rng = random.Random(3)
    bits = ["<|", "<\\|", "<\\\\|", "|>", "<|im_end|>", "<|im_start|>", "\n", "\\", "%0A", "%25", "%", "a", "é\U0001f600", "<|im_end|>\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(200)]
    roles = ["user", "assistant", "a\nb", "<|x", "%0A", "", "tool%"]
    rows = [(i % 20, i, None, "message", roles[i % 7], t) for i, t in enumerate(texts)]
    rows.append((99, 0, None, "message", "assistant", "z" * 200_000))
    df = spark.createDataFrame(rows, "conv_id long, seq long, msg string, kind string, role string, text string")
    out = chat.read_back(chat.format_chats(df)).collect()
    for r in out:
        want = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])
        assert [(m["role"], m["text"]) for m in r["messages"]] == [(x[4], x[5]) for x in want]
        assert r["formatted"].count("<|im_start|>") == len(want)
        for turn, x in zip(r["turns"], want):
            part = r["formatted"][turn["start"] : turn["end"]]
            assert re.sub(r"<\\(\\*)\|", r"<\1|", part) == x[5] and turn["loss"] == (x[4] == "assistant")


def test_texts_follow_the_spans(spark):
    rows = [(1, i, None, "message", r, t) for i, (r, t) in enumerate([("user", "é<|a"), ("assistant", "abc"), ("user", ""), ("assistant", "xyz")])]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, seq long, msg string, kind string, role string, text string"))
    read = lambda df: [m["text"] for m in chat.read_back(df).collect()[0]["messages"]]
    assert read(out) == ["é<|a", "abc", "", "xyz"]
    kind = out.schema["turns"].dataType.simpleString()
    empty = out.withColumn("turns", F.expr(f"cast(transform(turns, t -> struct(t.start, t.start, t.loss)) as {kind})"))
    assert read(empty) == [""] * 4
    short = out.withColumn("turns", F.expr(f"cast(transform(turns, (t, i) -> struct(t.start, t.`end` - int(i = 3), t.loss)) as {kind})"))
    assert read(short) == ["é<|a", "abc", "", "xy"]


# --- shards


def test_shards_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_shards(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    by = {}
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shards_spread_equal_rows_and_mix(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(None, "same " * 50, 1)] * 3000 + [(i, None, 2) for i in range(3000)], "doc_id long, text string, bucket int").coalesce(4).write.parquet(path)
    df = spark.read.parquet(path)
    out = shards.shard(df, 5, bucket_bytes=50_000)
    assert set(out.columns) == {"doc_id", "text", "bucket", "shard", "slot"}
    rows = out.collect()
    assert sorted((r["doc_id"] or -1, r["bucket"]) for r in rows) == sorted([(-1, 1)] * 3000 + [(i or -1, 2) for i in range(3000)])
    again = {(r["shard"], r["slot"]): (r["doc_id"], r["bucket"]) for r in shards.shard(df, 5, bucket_bytes=50_000).collect()}
    assert again == {(r["shard"], r["slot"]): (r["doc_id"], r["bucket"]) for r in rows}
    other = {(r["shard"], r["slot"]): (r["doc_id"], r["bucket"]) for r in shards.shard(df, 5, seed=1, bucket_bytes=50_000).collect()}
    assert other != again
    firsts = [r["bucket"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert 400 < sum(b == 1 for b in firsts[:1200]) < 800
    n = shards.bucket_count(df, "text", 50_000)
    sizes = shards.shuffled_buckets(df, n).groupBy("bucket").count().agg(F.max("count"), F.min("count")).first()
    assert n > 10 and sizes[0] < 3 * sizes[1]
    target = str(tmp_path / "out")
    shards.write_shards(out, target)
    assert spark.read.parquet(target).groupBy("shard").count().count() == 5
    assert shards.shard(df.limit(0), 5).count() == 0


# --- pseudonyms


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


FOUND = {
    "email": r"[\w.+-]+@mail\d\.example\.com", "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])",
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "card": r"(?<!\w)\d{16}(?!\w)",
}


def test_pseudonyms_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_pii(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    mapped, total = {}, 0
    for r in rows:
        before = docs[r["doc_id"]]
        for kind, pattern in FOUND.items():
            old, new = re.findall(pattern, before), re.findall(pattern, r["text"])
            if kind == "card":
                assert [a == b for a, b in zip(old, new)] == [not luhn(a) for a in old]
                old, new = [a for a in old if luhn(a)], [b for a, b in zip(old, new) if luhn(a)]
            assert len(old) == len(new) and r[f"n_{kind}"] >= len(old)
            for a, b in zip(old, new):
                assert mapped.setdefault(a, b) == b and a != b
                assert kind != "card" or (luhn(a) and luhn(b))
                total += 1
        outside = re.compile("|".join(FOUND.values()))
        assert outside.sub("", before) == outside.sub("", r["text"])
    assert total > 50 and len(set(mapped.values())) == len(mapped)


def test_every_format_is_a_permutation_that_can_be_undone(spark):
    rng = random.Random(8)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = [f"{rng.choice('abz')}{d(rng.randrange(1, 30))}.x@a-{d(1)}.org" for _ in range(60)]
    values += [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(60)]
    values += [f"{rng.randrange(1901, 2097)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}" for _ in range(60)]
    values += ["2000-02-29", "29/02/2096", "01.01.1901", "31/12/2096", "+44 20 7946 " + d(4), "(555) 123-4567", "555-123-4567"]
    values += [f"{d(3)}-{d(2)}-{d(4)}" for _ in range(30)]
    bodies = [str(rng.randrange(1, 10)) + d(rng.randrange(11, 18)) for _ in range(40)]
    values += [next(b + c for c in "0123456789" if luhn(b + c)) for b in bodies]
    docs = spark.createDataFrame([(i, f"x {v}, y") for i, v in enumerate(values)], "doc_id long, text string")
    new = pii.pseudonymize(docs, "k1")
    rows = {r["doc_id"]: r for r in new.collect()}
    assert all(len(rows[i]["pii"]) == 1 for i in range(len(values))), [v for i, v in enumerate(values) if len(rows[i]["pii"]) != 1]
    assert len({r["text"] for r in rows.values()}) == len(set(values))
    back = pii.pseudonymize(new.drop("pii"), "k1", undo=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: f"x {v}, y" for i, v in enumerate(values)}
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs, "k2").collect()}
    assert sum(other[i] == rows[i]["text"] for i in other) < 3


def test_a_small_domain_is_permuted_as_a_whole(spark):
    pairs = spark.range(7 * 11).select(F.floor(F.col("id") / 11).alias("a"), (F.col("id") % 11).alias("b"))
    out = pairs.select(pii.feistel(F.col("a"), F.col("b"), F.lit(7), F.lit(11), F.lit("t"), "key").alias("p")).collect()
    assert len({tuple(r["p"]) for r in out}) == 77 and all(0 <= r["p"]["a"] < 7 and 0 <= r["p"]["b"] < 11 for r in out)


def test_what_does_not_validate_stays(spark):
    texts = [None, "", "1.2.3.4.5 256.1.1.1 2023-02-29 13/13/2000 4791239852468396 123456", "a@b", "x" * 200_000 + "@", "é " * 1000]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)] + [(1, "", "p")], "doc_id long, text string, pii string")
    out = pii.pseudonymize(docs, "k")
    assert sorted(out.columns) == ["doc_id", "pii", "text"]
    assert sorted(((r["doc_id"], r["text"], len(r["pii"])) for r in out.collect()), key=str) == sorted(
        [(i, t, 0) for i, t in enumerate(texts)] + [(1, "", 0)], key=str
    )
    assert pii.pseudonymize(docs.limit(0), "k").count() == 0


def test_a_neighbouring_number_hides_no_value(spark):
    sf01 = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (1377, 7052)")
    for r in pii.pseudonymize(sf01.select("doc_id", "text", F.col("text").alias("old")), "k").collect():
        for kind in ("phone", "ip"):
            old, new = re.findall(FOUND[kind], r["old"]), re.findall(FOUND[kind], r["text"])
            assert old and len(old) == len(new) and not set(old) & set(new), (r["doc_id"], kind)
    phone, card, many = "+1 555 123 4567", "4111 1111 1111 1111", "+49 30 1234567"
    cases = {
        phone: [phone], f"{phone} 12": [phone, " 12"], f"{phone} 190.137.223.204": [phone, " ", "190.137.223.204"],
        f"{many} 190.137.223.204": [many, " ", "190.137.223.204"], f"{many} 2020-05-01": [many, " ", "2020-05-01"],
        f"{many} {card}": [many, " ", card], f"{many} (555) 123-4567": [many, " ", "(555) 123-4567"],
        card: [card], f"order 12345 {card}": ["order 12345 ", card], f"1234 {card}": ["1234 ", card], f"{card} 1234": [card, " 1234"],
        f"{card} {card}": [card, " ", card], f"{card} 190.137.223.204": [card, " ", "190.137.223.204"],
        "7 4111111111111111 8": ["7 ", "4111111111111111", " 8"], "41 11111111111111 5th": ["41 11111111111111", " 5th"],
        f"2023-02-30 {card}": ["2023-02-30 ", card], "+++@10.1.2.3": ["+++@", "10.1.2.3"], "1 2 " * 3000 + card: None,
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    new = pii.pseudonymize(docs, "k")
    rows = {r["doc_id"]: r for r in new.collect()}
    alone = {v: w for i, (v, parts) in enumerate(cases.items()) for w in [rows[i]["text"]] if parts == [v]}
    for i, (text, parts) in enumerate(cases.items()):
        if parts is None:
            continue
        pseudonyms = iter(v["new"] for v in rows[i]["pii"])
        got = [next(pseudonyms) if re.search(r"\d{4}|\d\.\d", p) and p[0] != " " and not p.endswith(" ") else p for p in parts]
        assert "".join(got) == rows[i]["text"] and not list(pseudonyms), (text, rows[i])
        assert all(g != p and g == alone.get(p, g) for g, p in zip(got, parts) if g != p or p in alone), (text, got)
    assert len(rows) == len(cases)


def test_month_first_dates_and_blanks_in_phones(spark):
    values = [f"{m:02}/{d}/{y}" for m in (1, 3, 12) for d in (13, 25, 31) for y in (1901, 2000, 2096)]
    values += ["02/29/2000", "02/28/2001", "555 123 4567", "555 123 4568"]
    docs = spark.createDataFrame([(i, f"on {v}, x") for i, v in enumerate(values)], "doc_id long, text string")
    new = pii.pseudonymize(docs, "k")
    rows = {r["doc_id"]: r for r in new.collect()}
    assert [[p["kind"] for p in rows[i]["pii"]] for i in range(len(values))] == [["date"]] * (len(values) - 2) + [["phone"]] * 2
    assert len({r["text"] for r in rows.values()}) == len(values) and sum(rows[i]["text"] == f"on {v}, x" for i, v in enumerate(values)) < 2
    assert all(int(re.search(r"/(\d\d)/", rows[i]["text"])[1]) > 12 for i in range(len(values) - 2))
    back = pii.pseudonymize(new.drop("pii"), "k", undo=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: f"on {v}, x" for i, v in enumerate(values)}
    stays = spark.createDataFrame([(0, "02/30/2000 13/13/2000 02/29/2001")], "doc_id long, text string")
    assert pii.pseudonymize(stays, "k").first()["pii"] == []
