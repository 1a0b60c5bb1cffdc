import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import chat, media, mixing, packing
from relspark.llm.queries import tokenizer_path

ODD = [None, "", " ", "a", "<|endoftext|>b c's", "İ$ é́≠ 一二 ９9", "word " * 5000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)


def test_ids_are_the_tokenizers(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, enc = Tokenizer.from_file(tokenizer_path()), packing.WordEncoder(tokenizer_path(), 50)
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("aB é́≠'ſİsST.,!# <|endoftext|>\x1c\xa0\x85½9一\n\t‍ßΣς$") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for part in (texts[:1500], texts[1500:]):
        ids, ends = enc.texts(pa.array(part))
        begin = 0
        for x, end in zip(part, ends.tolist(), strict=True):
            assert ids[begin:end].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)
            begin = end


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(tokenizer_path()), random.Random(2)
    texts = ODD + [" ".join(r.choice(["sea", "over", "hills", "morning"]) for _ in range(r.randint(1, 900))) for _ in range(200)]
    rows = packing.pack(frame(spark, texts), tokenizer_path(), with_ids=True).collect()
    docs, seqs = {}, {}
    for x in rows:
        docs.setdefault(x["doc_id"], []).append(x)
        seqs.setdefault(x["sequence_id"], []).append(x)
        assert zlib.crc32(np.array(x["ids"], "<u4").tobytes()) == x["ids_crc32"] and len(x["ids"]) == x["length"]
    for i, text in enumerate(texts):
        p = sorted(docs[i], key=lambda x: x["start"])
        ids = [v for x in p for v in x["ids"]]
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 1] and all(x["doc_tokens"] == len(ids) for x in p)
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for x in sorted(s, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 2048 and s[0]["padded"] == (at if at & (at - 1) == 0 else 2048)
    assert sum(x["length"] for x in rows) / (2048 * len(seqs)) > 0.97
    assert packing.pack(frame(spark, ["x"]).limit(0), tokenizer_path()).count() == 0


def test_plans_hold_every_piece_once():
    r = random.Random(3)
    for _ in range(100):
        counts = {r.randint(1, 64): r.randint(1, 300) for _ in range(r.randint(1, 30))}
        plan = packing.shortest_pack_first(counts, 64)
        held = Counter()
        for times, lengths in plan:
            assert sum(lengths) <= 64 and list(lengths) == sorted(lengths, reverse=True)
            for n in lengths:
                held[n] += times
        assert held == counts


def test_schedule_stays_within_a_block():
    r = random.Random(4)
    for _ in range(30):
        weights = {f"s{i}": r.random() ** 3 + 1e-3 for i in range(r.randint(1, 40))}
        parts = mixing.shares(weights)
        total, plan = sum(parts.values()), mixing.schedule(parts)
        order = sorted((x[2], s) for s, v in plan.items() for x in v)
        assert [t for t, _ in order] == list(range(total)) and {s: len(v) for s, v in plan.items()} == parts
        assert all(a <= t < d for v in plan.values() for a, d, t in v)
        had = Counter()
        for t, s in order:
            had[s] += 1
            assert all(abs(had[x] - k * (t + 1) / total) < 1 for x, k in parts.items())


@pytest.mark.parametrize("weights", [{"big": 0.5} | {f"s{i}": 0.001 for i in range(500)}, {"a": 1 / 3, "b": 2 / 3}, {"a": 7, "b": 2, "c": 1}, {"a": 0.123457, "b": 0.3, "c": 0.576543}, {"a": 10**6, "b": 1}])
def test_weights_are_met_as_given(weights):
    parts, exact, off = mixing.shares(weights), mixing.targets(weights), mixing.drift(weights)
    total = sum(parts.values())
    assert total <= mixing.MAX_SLOTS and off <= 1 / mixing.MAX_SLOTS
    if len(weights) == 501:
        assert off == 0 and parts["big"] == 500 * parts["s0"]
    had = Counter()
    for t, s in sorted((x[2], s) for s, v in mixing.schedule(parts).items() for x in v)[:3000]:
        had[s] += 1
        assert all(abs(had[x] - float(w) * (t + 1)) < 1 + (t + 1) * off + 1e-9 for x, w in exact.items())
    assert len(weights) < 501 or had["big"] >= 499


def test_mixture_keeps_every_document(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "clash") for i in range(300)] + [(None, None, None), (5, "s0", "again")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string").repartition(3)
    out = mixing.mix(df, block=4).collect()
    assert len(out) == len(rows)
    per = Counter((r["source"], r["block_index"]) for r in out)
    assert max(per.values()) <= 4
    slots = {}
    for r in out:
        assert slots.setdefault(r["slot"], (r["source"], r["block_index"])) == (r["source"], r["block_index"]) and r["release"] <= r["slot"] < r["deadline"]
    done = mixing.mixed(df.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert done.columns == df.columns and done.count() == 300
    with pytest.raises(ValueError):
        mixing.mix(df, {"hot": 1.0})
    assert mixing.mix(df.limit(0)).count() == 0


def test_media_round_trip(spark):
    png = media.encode(b"x" * 192, "image/png")
    texts = ODD + ["RIFF BM GIF89a \x89PNG", png.decode("latin-1"), "é" * 96, "z" * 192]
    got = media.text_media(frame(spark, texts)).orderBy("doc_id").collect()
    import hashlib

    for row, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        want = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert row["payload_bytes"] % 192 == 0 and row["payload_bytes"] > 0


def test_sniffing_corrects_and_carves(spark):
    wav, bmp, png = (media.encode(bytes(range(192)), k) for k in media.MADE)
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04abxyz\xff\xd9"
    gz = __import__("gzip").compress(b"data" * 40)
    rows = [(1, b"junk" + wav + b"BM" + png + b"tail", "image/png"), (2, bmp, "image/bmp"), (3, wav[:-1], "audio/wav"), (4, None, None), (5, b"", "x"), (6, b".." + gif + jpeg + gz + b"..", "text/plain"), (7, png[:-5] + b"?" + png[-4:], "image/png")]
    df = spark.createDataFrame(rows, "doc_id long, blob binary, kind string")
    out = {}
    for r in media.sniffed(df, "doc_id", "blob", "kind").collect():
        out.setdefault(r["id"], []).append((r["offset"], r["type"], r["corrected"], r["media"] and bytes(r["media"])))
    assert [x[1:] for x in sorted(out[1])] == [("audio/wav", True, wav), ("image/png", False, png)]
    assert out[2] == [(0, "image/bmp", False, bmp)] and out[3] == [(None, "audio/wav", False, None)] and out[4][0][1] is None and out[7][0][3] is None
    assert [x[1] for x in sorted(out[6])] == ["image/gif", "image/jpeg", "application/gzip"] and sorted(out[6])[2][3] == gz


def test_chat_roles_come_back(spark):
    text = "System: be brief\n\nUser: what is a: thing?\nmore of it\n\nAssistant: an answer\n\n1. first\n2. second\n\nUser: thanks"
    rows = [(1, text), (2, "### Human:\nhi\n\n### Assistant:\nhello"), (3, None), (4, ""), (5, "no marker at all\nsecond line"), (6, "Q: one?\nA: yes")]
    turns = {}
    for r in chat.render(chat.parse(spark.createDataFrame(rows, "conv_id long, text string"))).collect():
        turns.setdefault(r["id"], {})[r["turn"]] = (r["role"], r["text"], r["rendered"])
    got = lambda i: [turns[i][k][:2] for k in sorted(turns[i])]
    assert got(1) == [("system", "be brief"), ("user", "what is a: thing?\nmore of it"), ("assistant", "an answer\n\n1. first\n2. second"), ("user", "thanks")]
    assert got(2) == [("user", "hi"), ("assistant", "hello")] and got(6) == [("user", "one?"), ("assistant", "yes")]
    assert len(turns[3]) == len(turns[4]) == len(turns[5]) == 1 and turns[2][0][2] == "<|user|>\nhi\n<|end|>"


def test_long_transcripts_are_decoded_alike(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["User: ", "Assistant: ", "", "", "Note: ", "system: "]) + r.choice(["a", "b c", ""]) for _ in range(90))) for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, text string")
    want = sorted(map(tuple, chat.parse(df).collect()))
    monkeypatch.setattr(chat, "LINES", 7)
    assert sorted(map(tuple, chat.parse(df).collect())) == want


def test_conversations_in_every_style(spark):
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([("user", "hello there"), ("assistant", "line one\n\nline two"), ("user", "")])] + [(99, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(3))
    got = {(r["conv_id"], r["turn"]): (r["role"], r["rendered"]) for r in chat.formatted(df).collect()}
    for c in range(30):
        assert got[c, 0] == ("user", "<|user|>\nhello there\n<|end|>") and got[c, 1] == ("assistant", "<|assistant|>\nline one\n\nline two\n<|end|>")
    assert chat.formatted(df.limit(0)).count() == 0


def test_the_rest_does_not_import_this_subpackage():
    root = Path(packing.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_decoding_against_every_path():
    r, lines = random.Random(12), ["User: a", "Assistant: b", "", "text", "1. x", "System: c", "note: d"]
    for _ in range(25):
        some = [r.choice(lines) for _ in range(r.randint(1, 5))]
        e = chat.observe(some)
        best, paths = None, [()]
        for _ in some:
            paths = [(*p, s) for p in paths for s in range(chat.STATES)]
        for p in paths:
            score = chat.START[p[0]] + e[0][p[0]] + sum(chat.STEP[p[i - 1], p[i]] + e[i][p[i]] for i in range(1, len(p)))
            if best is None or score > best[0]:
                best = score, list(p)
        assert chat.decode(e, chat.START) == best[1]


def test_transcripts_of_blank_lines_and_of_one_id(spark):
    t = "User: hi" + "\n" * 100_000 + "x...\n\n\t\nAssistant: yes" + "\n \n" * 3000
    rows = [(1, t), (1, "User: a\n\nAssistant: b"), (1, "User: a\n\nAssistant: b"), (None, "\n\n"), (None, t)]
    got = Counter((r["id"], r["turn"], r["role"], r["text"]) for r in chat.parse(spark.createDataFrame(rows, "conv_id long, text string")).collect())
    body = "hi" + "\n" * 100_000 + "x..."
    assert got == {(1, 0, "user", body): 1, (1, 1, "assistant", "yes"): 1, (1, 0, "user", "a"): 2, (1, 1, "assistant", "b"): 2, (None, 0, "user", ""): 1, (None, 0, "user", body): 1, (None, 1, "assistant", "yes"): 1}
    assert chat.parse(spark.createDataFrame(rows, "conv_id long, text string").limit(0)).count() == 0


def test_pieces_are_one_transcript(spark, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2], f"said {t}" + "\nmore" * (t % 5 == 1)) for c in (1, None) for t in range(300)] + [(2, None, "user", "same")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = sorted((r["conv_id"] or -1, r["turn"], r["role"], r["rendered"]) for r in chat.formatted(df).collect())
    for c in (-1, 1):  # every eighth turn is written without a marker: its role comes from the turns around it
        assert [(t, r, x) for i, t, r, x in whole if i == c] == [(t, r, f"<|{r}|>\n{x}\n<|end|>") for i, t, r, x in rows if (i or -1) == c]
    monkeypatch.setattr(chat, "LINES", 50)
    monkeypatch.setattr(chat, "PIECES", 2)
    turns = chat.parse(chat.transcripts(df, 16, 0), "conv_id", "text", "seq")
    one = sorted((r["id"] or -1, r["turn"], r["role"], r["text"]) for r in turns.collect())
    assert [x for x in one if x[0] != 2] == [(i, t, r, x.split("\n", 1)[1][: -len("\n<|end|>")]) for i, t, r, x in whole if i != 2]
    assert sum(x[0] == 2 for x in one) == 40


def test_mixture_keeps_clashing_columns_and_repeated_rows(spark):
    rows = [(i % 50, "ab"[i % 2], i, "x") for i in range(100)] + [(7, "a", 1, "x")] * 60 + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, _slot int, rank string").repartition(4)
    staged = mixing.staged(df, "test")
    out = mixing.mixed(staged, {"a": 3.0, "b": 1.0, "": 1.0}, block=2)
    assert out.columns == df.columns and Counter(map(tuple, out.collect())) == Counter(rows)
    first = [r["source"] for r in out.collect()][:64]
    assert 1.8 < first.count("a") / max(1, first.count("b")) < 4.5
    assert mixing.mixed(staged.limit(0)).count() == 0


def test_packing_follows_an_order(spark):
    texts = ["word " * (i % 40 + 1) for i in range(400)]
    df = frame(spark, texts)
    rows = packing.pack(df, tokenizer_path(), size=64, place=-F.col("doc_id")).collect()
    assert sorted({r["sequence_id"] for r in rows}) == list(range(len({r["sequence_id"] for r in rows})))
    first = {}
    for r in rows:
        first[r["sequence_id"]] = max(first.get(r["sequence_id"], -1), r["doc_id"])
    assert [first[s] for s in sorted(first)] == sorted(first.values(), reverse=True)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in by.values():
        assert sum(r["length"] for r in s) <= 64
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]


def test_other_tokenizer_files_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"the": 0, "[UNK]": 1}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        packing.WordEncoder(str(tmp_path / "t.json"))


def test_empty_tables_and_repeated_rows_of_media(spark):
    df = frame(spark, ["a", "a", None])
    assert media.text_media(df.limit(0)).count() == 0
    rows = media.text_media(df.unionAll(df)).collect()
    assert len(rows) == 6 and len({tuple(r)[1:] for r in rows}) == 2
    hostile = spark.createDataFrame([(1, b"\xff\xd8\xff\xda\x00\x02" * 40_000, "x"), (2, b"\x1f\x8b\x08" * 40_000, "x")], "doc_id long, blob binary, kind string")
    assert [r["length"] for r in media.sniffed(hostile, "doc_id", "blob", "kind").collect()] == [0, 0]
