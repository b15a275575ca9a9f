"""Quality rules against brute force."""

import math
import random
import statistics
from collections import Counter

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlkit.llm import fertility, queries
from crawlkit.llm.queries import FERTILITY


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def rules(text):
    w = words(text)
    threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def measures(text):
    ids = fertility._bytes_vocabulary(*FERTILITY[:2]).encode_ordinary(text)
    model = sentencepiece.SentencePieceProcessor(model_file=FERTILITY[2])
    own = model.encode(text)
    n = max(len(ids), 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    return len(ids), round(1000 * len(text) / n), round(1000 * sum(map(model.is_byte, own)) / max(len(own), 1)), entropy * 1000


def bands(rows, keys, name):
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r[name])
    out = {}
    for key, values in groups.items():
        if len(values) >= fertility.LEAST_DOCS:
            m = statistics.median(values)
            d = max(1.4826 * statistics.median(abs(v - m) for v in values), fertility.FLOORS[name])
            out[key] = (m - fertility.WIDTHS[name] * d, m + fertility.WIDTHS[name] * d)
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r.asDict() for r in queries.op2_fertility(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = []
    for d in docs:
        g = got[d["doc_id"]]
        assert rules(d["text"]) == tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        n, per_token, fallback, entropy = measures(d["text"])
        assert (n, per_token, fallback) == (g["n_tokens"], g["per_token"], g["fallback"])
        assert abs(entropy - g["entropy"]) <= 0.51
        assert g["base_failed"] == (g["n_words"] < 50 or 2 * g["n_repeat_words"] > g["n_words"])
        octave = min(math.floor(2 * math.log2(max(n, 1))), fertility.LAST_OCTAVE)
        rows.append(g | {"lang": d["lang"], "octave": octave, "script": fertility.script_of(d["text"])})
    sound = [r for r in rows if not r["base_failed"]]
    for r in rows:
        kept = not r["base_failed"]
        for name, more in (("per_token", []), ("fallback", []), ("entropy", ["octave"])):
            low = high = None
            for first in ("script", "lang"):
                found = remembered(sound, first, more, name).get(tuple(r[k] for k in [first, *more]))
                if found:
                    low, high = found
            if low is not None:
                kept &= not (name != "fallback" and r[name] < low) and not (name != "entropy" and r[name] > high)
        assert kept == r["kept"], r
    assert sum(not r["kept"] and not r["base_failed"] for r in rows) > 0


_CACHE = {}


def remembered(sound, first, more, name):
    key = (first, name)
    if key not in _CACHE:
        _CACHE[key] = bands(sound, [first, *more], name)
    return _CACHE[key]


def test_rules_on_odd_texts(docs_of):
    rng = random.Random(2)
    texts = ["", " \n\t", "a a a a a", "x\n x\nx\nx", "a b c a b c d", "#*$%&|<> é", "\x1c\x85\xa0 a", "x" * 200_000, "ab " * 60_000]
    texts += ["".join(rng.choice("ab \n|") for _ in range(rng.randrange(200))) for _ in range(100)]
    out = fertility.measure(docs_of([*texts, None]), *FERTILITY).select("doc_id", "m.*").collect()
    for r in out:
        assert tuple(r)[1:6] == rules(texts[r["doc_id"]] if r["doc_id"] < len(texts) else "")


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice("the of and water people house green small river under stone walking little".split()) for _ in range(120))
    texts = [prose() for _ in range(80)] + ["Øß¤ " * 5 + prose().replace("e", "ȝ"), prose().upper().replace(" ", "!! ")]
    docs = spark.createDataFrame([(i, t, None, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, m int, octave string")
    out = fertility.judge(fertility.measure(docs, *FERTILITY))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] for i in range(80)) and not kept[80] and not kept[81]
    assert "octave" in out.columns


def test_empty_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "a", "en"), (1, "a", "en")], "doc_id long, text string, lang string")
    assert [r["kept"] for r in fertility.judge(fertility.measure(docs, *FERTILITY)).collect()] == [False] * 3
    assert fertility.judge(fertility.measure(docs.limit(0), *FERTILITY)).count() == 0


COUNTS = fertility.PieceCounts(FERTILITY[2])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("aeinrst  \n▁　\U0001f600"))))
def test_pieces_by_segment(text):
    ids = COUNTS.model.encode(text)
    assert COUNTS.apart and COUNTS.of(text) == (len(ids), sum(map(COUNTS.model.is_byte, ids)))


def test_known_segments_are_not_merged_again(monkeypatch):
    counts = fertility.PieceCounts(FERTILITY[2])
    monkeypatch.setattr(fertility, "REMEMBERED", 5)
    text = "the old \x00 日本語 " + "x" * 100 + " the end"
    first = counts.of(text)
    assert first == counts._whole(text) and not counts.known  # six were new, and are forgotten
    monkeypatch.setattr(fertility, "REMEMBERED", 50)
    assert counts.of(text) == first and len(counts.known) == 5  # all but the long one
    short = text.replace("x" * 100 + " ", "")
    whole = counts._whole(short)
    monkeypatch.setattr(counts, "_learn", None)
    assert counts.of(short) == whole
