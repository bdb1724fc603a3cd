"""Edge cases of the operators: scripts, wrapped notices, long texts, hot keys, clashing names, repeated rows."""

import itertools
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import common, licences, mixing, pieces, pii, quality, sharding, simhash, tokens, topk, toxicity, vocab

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def made(spark, texts):
    return [r.text for r in pii.pseudonymise(frame(spark, texts)).orderBy("doc_id").collect()]


# surrogates


def test_names_of_any_script_move(spark):
    names = ["Παπαδόπουλος", "Łódź", "王小明", "Müller", "Nguyễn", "Шевченко", "Ґалаґан", "כהן", "김철수", "O'Brien", "Smith-Jones"]
    got = made(spark, [f"Dr {n} came" for n in names])
    out = [g.removeprefix("Dr ").removesuffix(" came") for g in got]
    assert all(a != b and len(a) == len(b) for a, b in zip(names, out))
    for a, b in zip(names, out):  # hardly a letter stays where it was
        assert sum(x == y for x, y in zip(a, b) if x.isalpha()) <= len(a) // 2
        assert [x.isupper() for x in a] == [x.isupper() for x in b]
    assert made(spark, ["Mr McDonald spoke", "Mr Mcdonald spoke", "Mr MCDONALD spoke"])[0].lower() == made(spark, ["Mr Mcdonald spoke"])[0].lower()


def test_bare_mentions_follow_the_name(spark):
    text = "Smith left early. Mr John Smith came. Smith said John left; SMITH's dog, Smithson and john stayed. Mrs Anna B. Li saw Li and J. Smith."
    (got,) = pii.pseudonymise(frame(spark, [text])).collect()
    by = {e.found: e.made for e in got.entities}
    john, smith = by["Mr John Smith"].split()[1:]
    assert (by["Smith"], by["John"], by["SMITH"]) == (smith, john, smith.upper()) and john.lower() in pii.GIVEN["male"]
    assert by["Li"] == by["Mrs Anna B. Li"].split()[-1]
    assert "Smithson and john stayed" in got.text and f"{smith.upper()}'s dog" in got.text and got.text.startswith(f"{smith} left early. Mr {john} {smith} came.")
    initial = made(spark, ["Mr J. Smith left", "Prof J.R. Smith left"])
    assert initial[0].endswith(f"{smith} left") and re.fullmatch(r"Mr [A-Z]\. \w+ left", initial[0]) and not initial[0].startswith("Mr J.") and smith in initial[1]


def test_phones_in_national_groups(spark):
    same = ["+33 1 23 45 67 89", "01 23 45 67 89", "01.23.45.67.89", "+33123456789"]
    other = ["555 123 4567", "555-123-4567", "030/1234567", "+44 20 7946 0958", "+1 (017) 555-7713"]
    rows = pii.pseudonymise(frame(spark, [f"call {p} now" for p in same + other])).orderBy("doc_id").collect()
    assert all(len(r.entities) == 1 and r.entities[0].kind == "phone" for r in rows)
    shape = lambda s: re.sub(r"\d", "0", s)
    assert all(shape(e.found) == shape(e.made) != e.made for r in rows for e in r.entities)
    digits = [re.sub(r"\D", "", r.entities[0].made) for r in rows]
    assert digits[0] == digits[3] and digits[1] == digits[2] and digits[0][2:] == digits[1][1:] and digits[4] == digits[5]


def test_accounts_keep_right_check_digits(spark):
    right = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    good = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"]
    bad = ["DE88 3704 0044 0532 0130 00", "GB83 WEST 1234 5698 7654 32"]
    got = [r.entities[0].made for r in pii.pseudonymise(frame(spark, good + bad)).orderBy("doc_id").collect()]
    assert [right(g.replace(" ", "")) for g in got] == [True] * 3 + [False] * 2 and all(g[:2] == s[:2] and len(g) == len(s) for g, s in zip(got, good + bad))


def test_a_surrogate_that_is_somebody_else_gets_a_tweak(spark):
    first = "555-123-4567"
    second = made(spark, [first])[0]
    out = pii.pseudonymise(frame(spark, [first, f"{second} and {first}", "nobody", "Mr Ö of Ä. Mr Li"])).orderBy("doc_id").collect()
    found = {e.found: e.made for r in out for e in r.entities}
    assert found[first] not in (first, second) and found[second] not in (first, second) and found[first] != found[second]
    assert out[0].text == found[first] and out[1].text == f"{found[second]} and {found[first]}" and out[2].text == "nobody"
    assert found["Mr Li"] != "Mr Li"


def test_repeated_rows_clashes_and_long_texts(spark):
    text = "Mr John Smith and John. " * 3 + "word " * 200_000 + "a.b@c.org Smith"
    df = spark.createDataFrame([(1, text, 5, "x", "y")] * 2 + [(2, None, 6, None, None)], "doc_id long, text string, entities int, rid string, tweak string").repartition(2)
    out = pii.pseudonymise(df)
    assert out.columns == ["doc_id", "text", "input_entities", "rid", "tweak", "entities"]
    a, b, c = out.orderBy("doc_id").collect()
    assert a == b and len(a.entities) == 8 and a.input_entities == 5 and a.rid == "x" and len(a.text) == len(text) + (len(a.text.split("@")[1].split()[0]) - len("c.org")) + sum(len(e.made) - len(e.found) for e in a.entities if e.kind == "name")
    assert c.text is None and c.entities == []
    assert not [e for e in a.entities if e.found == e.made] and a.text.count("word ") == 200_000


# token counts


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(vocab.read(None, "byte_bpe_50k.tiktoken"))[0]


def test_long_white_space_encodes_as_the_library_does(encoder):
    rng = random.Random(3)
    kinds = [" ", "\n", "\t", "  \n", "\r\n", " ", "\xa0 "]
    for n in (4095, 4096, 5000, 20_001):
        for kind in kinds:
            run = (kind * n)[:n]
            for text in (run, f"a{run}b", f"a{run}", f"{run}1", f"x {run}\n{run} é{run}."):
                assert tokens.encode(encoder, text).tolist() == encoder.encode_ordinary(text)
    for _ in range(20):
        run = "".join(rng.choice(" \n\t") for _ in range(6000))
        text = f"one{run}two {run[:50]} three{run}"
        assert tokens.encode(encoder, text).tolist() == encoder.encode_ordinary(text)


def test_megabytes_of_one_character(spark, encoder):
    texts = ["a" + " " * 5_000_000 + "b", "\n" * 2_000_000, "word" + "\n \n" * 700_000 + "end"]
    got = tokens.attribute_tokens(frame(spark, texts)).groupBy("doc_id").agg(F.max("to_char").alias("n"), F.sum("tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(t) for i, t in enumerate(texts)} and all(r.t > 0 for r in got)


def test_sections_against_brute_force(spark, encoder):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", " ", "\n", "\n\n", "é", "日本", "12", ".\n"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    got = {(r.doc_id, r.section): (r.from_char, r.to_char, r.tokens, r.crossing) for r in tokens.attribute_tokens(frame(spark, texts), rule="first").collect()}
    for d, text in enumerate(texts):
        lines = text.splitlines(keepends=True) if "\r" not in text else None
        cuts = list(itertools.accumulate((len(x) for x in lines), initial=0))
        counts, crossing = [0] * len(lines), [0] * len(lines)
        raw, at = text.encode(), 0
        place = lambda byte: len(raw[: byte + 1].decode("utf-8", "ignore")) - (0 if raw[: byte + 1].decode("utf-8", "ignore").encode() != raw[: byte + 1] else 1)
        for token in encoder.encode_ordinary(text):
            size = len(encoder.decode_single_token_bytes(token))
            a, b = (next(i for i in range(len(lines)) if cuts[i] <= place(p) < cuts[i + 1]) for p in (at, at + size - 1))
            counts[a] += 1
            for i in range(a + 1, b + 1):
                crossing[i] += 1
            at += size
        assert [got[d, i] for i in range(len(lines))] == [(cuts[i], cuts[i + 1], counts[i], crossing[i]) for i in range(len(lines))]


# licences


def recognised(spark, texts):
    return [r.licences for r in licences.recognise(frame(spark, texts)).orderBy("doc_id").collect()]


def test_lines_and_wrapped_sentences_of_one_text_are_both_known(spark):
    s = licences.SENTENCES
    isc = "\n".join(textwrap.wrap(s["isc-grant"][0], 60))
    bsd = "\n".join(s[k][0] for k in ("bsd-lead", "bsd-source", "bsd-binary", "bsd-name"))
    got = recognised(spark, [f"License: MIT\n{isc}", f"MIT License\n{bsd}\n{isc}\nAll rights reserved.", f"{isc}\nLicense: MIT", f"All rights reserved. {isc}"])
    assert got[0] == ["ISC", "MIT"] and set(got[1]) == {"BSD-3-Clause", "ISC", "proprietary"} and got[2] == ["ISC", "MIT"] and set(got[3]) == {"ISC", "proprietary"}


def test_every_sentence_is_known_at_any_width(spark):
    cases = [(key, form, width, lead) for key, forms in licences.SENTENCES.items() for form in forms for width in (30, 47, 72, 10_000) for lead in ("", "# ", " * ", "// ")]
    data = [(i, "\n".join(lead + x for x in textwrap.wrap(form, width, break_on_hyphens=False, break_long_words=False))) for i, (_, form, width, lead) in enumerate(cases)]
    rows = licences.recognise(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert not [(cases[r.doc_id], r.text, r.sentence_ids) for r in rows if cases[r.doc_id][0] not in r.sentence_ids]


def test_licences_keep_clashing_columns_repeats_and_long_texts(spark):
    text = "prose. " * 300_000 + "\nSPDX-License-Identifier: MIT\n" + "more prose\n" * 100_000
    df = spark.createDataFrame([(1, text, "own", 3)] * 2 + [(2, "License: MIT\x01\x02", None, None)], "doc_id long, text string, licences string, sentence_ids int")
    out = licences.recognise(df)
    assert out.columns == ["doc_id", "text", "input_licences", "input_sentence_ids", "sentence_ids", "licences"]
    assert [(r.input_licences, r.licences) for r in out.orderBy("doc_id").collect()] == [("own", ["MIT"])] * 2 + [(None, ["MIT"])]


# hot keys, long chains, equal rows


def test_a_long_chain_has_one_root(spark):
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    stars = simhash.components(spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long"))
    assert {r.node: r.root for r in stars.collect()} == {i: 0 for i in range(1, n)}


def test_heavy_keys_join_as_all_others(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 5)
    monkeypatch.setattr(common, "HEAVY", 4)
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 2)
    rng = random.Random(8)
    clean = "some words that say a thing and never the same one twice because each sentence here goes on differently until it ends %d"
    data = [(i, clean % i if rng.random() < 0.7 else "short", rng.choice(["hot", "hot", "hot", None, f"h{i}"])) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    key = lambda r: (r.doc_id, r.n_words, r.base_failed, r.kept, round(r.host_rate, 12))
    few = sorted(map(key, quality.verdicts(df).collect()))
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 10_000)
    assert few == sorted(map(key, quality.verdicts(df).collect())) and len(few) == 300
    links = [(rng.randrange(400), rng.choice([0, 1, rng.randrange(400)])) for _ in range(300)]
    hot = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    monkeypatch.setattr(common, "FEW", 1 << 20)
    assert hot == {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}


def test_equal_rows_are_numbered_and_placed_by_their_count(spark):
    df = spark.createDataFrame([(7, "one two three", "s")] * 5000 + [(8, "four five", "s"), (8, "four six", "s")], "doc_id long, text string, source string").repartition(5)
    shards = sharding.assign_shards(df).collect()
    assert sorted(r.slot for r in shards if r.doc_id == 7) == list(range(5000)) or len({r.shard for r in shards}) == 1
    by = Counter((r.shard, r.slot) for r in shards)
    assert len(by) == len(shards) == 5002 and all(sorted(r.slot for r in shards if r.shard == s) == list(range(sum(x == s for x, _ in by))) for s in {r.shard for r in shards})
    mix = mixing.mix_documents(df, mixing.Mix(block=16, shards=3)).collect()
    assert len(mix) == 5002 and abs(sum(r.taken for r in mix) - 1.5 * (15_000 + 4)) <= 1 and all(r.taken <= 2 * r.size for r in mix)


# mixing


def test_every_shard_has_its_size_and_every_source_its_slots():
    rng = np.random.default_rng(1)
    for slots in ([1000, 200, 3], [5], [0, 7], [1] * 50, [10**6, 1, 10**5]):
        slots = np.array(slots)
        drawn = mixing.draw(slots, 8, np.random.default_rng(3))
        assert drawn.min() >= 0 and drawn.sum(0).tolist() == slots.tolist() and drawn.sum(1).max() - drawn.sum(1).min() <= 1
    many = np.array([mixing.draw(np.array([600, 300, 100]), 4, np.random.default_rng(i)) for i in range(300)])
    assert np.allclose(many.mean(0), [[150, 75, 25]] * 4, atol=3) and many[:, 0, 0].std() > 3
    assert rng is not None


def test_mixed_texts_with_clashing_columns_are_the_same_again(spark):
    rng = random.Random(2)
    data = [(i // 2, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 60))), rng.choice(["x", "y", None]), f"k{i}", i, i) for i in range(120)]
    data += [(1, data[2][1], data[2][2], "other", 1, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, h string, g long, spans long")
    once, again = (sorted(map(repr, mixing.mixed_texts(d, mixing.Mix(block=8, shards=3)).collect())) for d in (df, df.repartition(7)))
    assert once == again and once


# the other operators with clashing names and long texts


def test_quality_keeps_columns_that_are_called_as_results(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 9, True)], "doc_id long, text string, source string, n_words long, kept boolean")
    out = quality.verdicts(df, keep=("doc_id", "n_words", "kept"))
    (r,) = out.collect()
    assert (r.input_n_words, r.input_kept, r.n_words, r.kept) == (9, True, 3, False)


@pytest.mark.parametrize("text", ["word " * 1_200_000, "x" * 1_000_000, "日本語のとても長い文" * 150_000, "Some words. Other words!\n" * 220_000], ids=["words", "one word", "no spaces", "lines"])
def test_long_texts_go_through_every_operator(spark, text):
    df = spark.createDataFrame([(1, text, "s", 1), (2, "short one", "s", 1)], "doc_id long, text string, source string, n_chars long")
    assert simhash.near_groups(df).count() == 2
    (q,) = quality.verdicts(df).where("doc_id = 1").collect()
    assert q.n_words == len(WORD.findall(text)) and q.word_chars == sum(map(len, WORD.findall(text)))
    assert mixing.mix_documents(df).where("doc_id = 1").first().size == q.n_words
    assert pieces.encode_texts(df).where("doc_id = 1").first().round_trip
    assert tokens.attribute_tokens(df).where("doc_id = 1").agg(F.max("to_char")).first()[0] == len(text)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(df, labels).count() == 2
    assert licences.recognise(df).where("size(licences) = 0").count() == 2
    assert sharding.assign_shards(df).where(f"size = {len(text.encode()) + 8}").count() == 1


def test_topk_with_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0], 5, "q", 1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, v string, q int, rank int")
    got = topk.exact_topk(df, F.col("vec_id") % 10 == 0, k=3).collect()
    assert Counter(r.query_id for r in got) == {0: 3, 10: 3, 20: 3}


# near copies


def test_recall_of_near_copies_against_all_pairs(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 400))]
        base = base + passage if k % 3 == 0 else base
        texts.append(base)
        for share in (0.005, 0.01, 0.015, 0.02):
            texts.append([f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base])
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    df = frame(spark, [" ".join(t) for t in texts])
    group = {r.id: r.component_id for r in simhash.near_members(df, 2, 3, "doc_id", "text", (5, (4, 5))).select("id", "component_id").collect()}
    assert len(pairs) > 150 and np.mean([group[i] == group[j] for i, j in pairs]) >= 0.98
    assert all(group[i] // 5 == i // 5 for i in group)  # none joined by the passage alone


def test_parity_bits_never_rule_out_a_similar_pair():
    from weft.llm import overlap

    rng = np.random.default_rng(5)
    for n in (1, 3, 20, 33, 200, 900):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, max(1, n // 10), dtype=np.uint64)]))
            (x, _), (y, _) = (overlap.parity(s, np.zeros(len(s), np.int64), np.array([len(s)])) for s in (a, b))
            while len(x) != len(y):
                long = x if len(x) > len(y) else y
                short = long[: len(long) // 2] ^ long[len(long) // 2 :]
                x, y = (short, y) if len(x) > len(y) else (x, short)
            apart = sum(int(v).bit_count() for v in x ^ y)
            assert apart <= len(np.setxor1d(a, b))


def test_long_texts_score_and_encode_alike_in_parts():
    rng = random.Random(9)
    text = " ".join(rng.choice(["alpha", "be", "mo-ron", "x", "y", "z", "日本", "one."]) for _ in range(4000))
    model = pieces.Model(vocab.read(None, "piece_bpe_32k.model"))
    whole, parts = model.encode([text, "", None, "ab"]), model.encode([text, "", None, "ab"], most=500)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
    raw, at = model.decode(*parts)
    assert raw[at[0] : at[1]].tobytes().decode() == text
    cut = toxicity.parts_of(text, 700)
    assert len(cut) > 5 and " ".join(cut).split() == text.split()
    table = np.random.default_rng(1).normal(size=toxicity.SYMBOLS**toxicity.ORDER).astype(np.float32) / 10
    one = toxicity.word_scores(toxicity.word_stream([text]), table, -0.1)
    many = np.concatenate([toxicity.word_scores(toxicity.word_stream([p]), table, -0.1) for p in cut])
    assert np.allclose(np.sort(one), np.sort(many), atol=1e-3)


@pytest.mark.parametrize("block", [1024, 7])
def test_a_band_of_unlike_texts_keeps_every_similar_pair(spark, monkeypatch, block):
    from weft.llm import overlap, simhash

    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame([(2 * i + k, t + tail) for i, t in enumerate(texts) for k, tail in enumerate((" one", " two"))], "id long, text string")
    prints = lambda column: simhash.fingerprints(column, 3)
    rows = overlap.described(docs.select("id", F.col("text").alias("t"), F.xxhash64("text").alias("x")), ["id", "x"], 5, prints)
    rows = rows.withColumn("bands", F.array_repeat(F.lit(1).cast("long"), overlap.BANDS))
    none = spark.createDataFrame([], "node long, root long")
    stars = {r.node: r.root for r in overlap.join_components(docs, "text", rows, none, simhash.components, prints).collect()}
    by_root = {}
    for r in rows.select("id", "fp").collect():
        by_root.setdefault(stars.get(r.fp, r.fp), []).append(r.id // 2)
    assert len(by_root) == 30 and all(len(v) == 2 and v[0] == v[1] for v in by_root.values())
