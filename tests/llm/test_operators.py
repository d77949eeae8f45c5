"""Operators against brute force, libraries and round trips, on small tables with odd rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import flatwords as fw
from marlstone.llm import toxicity
from marlstone.llm.decontaminate import decontaminate, find_leaks
from marlstone.llm.jaccard_join import PrefixTree, _bitmap, _may_link, jaccard_groups
from marlstone.llm.license_scan import LicenseIndex, license_scan, places, words_of
from marlstone.llm.line_dedup import line_dedup
from marlstone.llm.piece_bpe import PieceModel, encode_decode
from marlstone.llm.substring_dedup import substring_dedup
from marlstone.llm.token_files import pack_blocks, read_token_files, unpack_blocks, write_token_files
from marlstone.llm.topk_search import topk_search
from marlstone.llm.url_filter import url_filter

PT = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string, row string, words int"


def corpus(seed=3, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(90)]
    phrase = [r.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        body = [r.choice(words) for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            body[10:10] = phrase
        rows.append((i, " ".join(body), "a" if i % 3 else "b", "x", 1))
    rows += [(100, rows[5][1], "a", "x", 1), (101, rows[5][1].upper(), None, "x", 1), (102, None, "a", None, None), (103, "", "a", "x", 1), (104, " \t\n", "a", "x", 1), (105, "one two", "a", "x", 1), (106, "one two", "b", "x", 1)]
    rows += [(107, " ".join(["again"] * 500), "a", "x", 1), (108, "word " * 40_000, "a", "x", 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def covered(rows, width=20):
    seen, out = {}, {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.setdefault(key, 1)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, batches):
    rows = corpus()
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(frame(spark, rows), batches=batches).collect()}
    assert got == covered(rows)


def test_substring_dedup_null_and_repeated_ids(spark):
    text = " ".join(f"k{i}" for i in range(25))
    got = sorted((r[0] is None, r[0] or 0, r[2]) for r in substring_dedup(frame(spark, [(1, text, "", "", 1), (1, text, "", "", 1), (2, text, "", "", 1), (None, None, "", "", 1)])).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 25), (True, 0, 0)]
    assert substring_dedup(frame(spark, [])).count() == 0


def groups(rows, width, percent):
    sets = {}
    for i, text, *_ in rows:
        w = tuple((text or "").encode().lower().split())
        sets[i] = frozenset(w[k : k + width] for k in range(len(w) - width + 1)) or (frozenset([w]) if w else frozenset())
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def test_jaccard_groups(spark):
    r = random.Random(1)
    rows = corpus(n=20)[:27]
    base = [f"v{i}" for i in range(80)]
    for k in range(25):  # near copies around the threshold
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(80)] = f"z{k}"
        rows.append((200 + k, " ".join(w), "a", "x", 1))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_groups(frame(spark, rows)).collect()}
    assert got == groups(rows, 4, 85)


def test_jaccard_groups_of_many_near_copies(spark):
    """Shingles beyond ``HOT_LEAST`` documents, copies on both sides of the threshold, and a passage in
    texts that have nothing else in common."""
    r = random.Random(5)
    base, passage = [f"v{i}" for i in range(120)], [f"p{i}" for i in range(30)]
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(k % 7):
            w[r.randrange(120)] = f"z{k}x{r.random()}"
        rows.append((k, " ".join(w), "a", "x", 1))
    rows += [(1000 + k, " ".join(passage + [f"u{k}y{j}" for j in range(3 + k % 40)]), "a", "x", 1) for k in range(20)]
    r.shuffle(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_groups(frame(spark, rows)).collect()}
    assert got == groups(rows, 4, 85)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for _ in range(400):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64))
        kept = x[rng.random(len(x)) < rng.choice([0.5, 0.85, 0.92, 0.99])]
        y = np.union1d(kept, rng.integers(0, 1 << 63, rng.integers(1, 30), dtype=np.uint64))
        linked = 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
        may = _may_link(len(x), len(y), _bitmap(x), _bitmap(y), 85)
        assert may or not linked
        ruled_out += not may
    assert ruled_out > 100


def test_prefix_tree():
    r = np.random.default_rng(2)
    lists = [np.unique(r.integers(0, 60, r.integers(1, 60))).astype(np.uint64) for _ in range(200)]
    query = lists[7]
    want = sorted(i for i, s in enumerate(lists) if 100 * len(np.intersect1d(s, query)) >= 60 * len(np.union1d(s, query)))
    assert sorted(PrefixTree(lists).search(query, 60)) == want


def test_sentencepiece(spark):
    import sentencepiece

    path = PT.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*corpus(n=8), (300, "é日本 <s> </s>  a\x00b\n ▁x", "a", "x", 1), (301, "ab" * 300 + " " * 70, "a", "x", 1)]
    want = {}
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        want[i] = (len(ids), " ".join(map(str, ids)), library.decode(ids))
    assert {r[0]: tuple(r)[1:] for r in encode_decode(frame(spark, rows), path).collect()} == want
    assert PieceModel(path).decode(library.encode("a  b é日")) == "a  b é日"


def test_merge_order_equals_the_library():
    import sentencepiece

    path = PT.path("piece_bpe_32k.model")
    library, model, r = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path), random.Random(9)
    words = ["".join(r.choice("abcdeinorst▁") for _ in range(r.randint(1, 40))) for _ in range(2000)]
    words = [w for w in words if "▁" not in w.lstrip("▁") and not w.startswith("▁")]
    assert [ids[1:] if ids[0] == 28705 else ids for ids in ([*x] for x in model.encode_words(["▁" + w for w in words]))] == [ids[1:] if ids[0] == 28705 else ids for ids in library.encode(words)]


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = PT.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*corpus(n=8), (300, "don't <|endoftext|> 　 日本\x1c x²", "a", "x", 1)]
    at, want = 0, {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    got = read_token_files(spark, write_token_files(frame(spark, rows), path, 2))
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 31, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_257, 2**32])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    if n > 40:
        ids[7] = 2**32 - 1
    data = pack_blocks(ids)
    assert (unpack_blocks(data) == ids).all()
    assert (unpack_blocks(data, 1, 2) == ids[1024:2048]).all()


def test_topk(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(0, 0.2, (120, 12)).round(1))]
    rows += [(200, None), (201, [None, 1.0]), (202, [float("nan")]), (None, [1.0]), (203, []), (20, rows[20][1]), (240, [1e30, 2.0]), (260, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q, a in good.items():
        if q % 20 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for i, b in good.items() if i != q)[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(x) for x in topk_search(df, F.col("id") % 20 == 0, query_block=4, candidate_block=32).collect()} == want


def test_line_dedup(spark):
    rows = [(i, f"menu \nown line {i}\n\n{'menu' if i == 1 else 'x'}", "a", "x", 1) for i in range(10)] + [(20, None, "a", "x", 1), (21, "menu", "b", "x", 1), (22, "", None, "x", 1), (None, "menu", None, "x", 1)]
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in line_dedup(frame(spark, rows)).collect()}
    assert got[(1, "own line 1\n")] == 2
    assert got[(2, "own line 2\n")] == 2  # the menu and the line "x"
    assert got[(20, None)] == 0 and got[(21, "menu")] == 0 and got[(22, "")] == 0 and got[(None, "menu")] == 0
    assert line_dedup(frame(spark, [])).count() == 0


def test_decontaminate(spark):
    r = random.Random(8)
    items = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(25))) for i in range(5)]
    near = items[2][1].replace("a", "A").replace(items[2][1][40:44], "zz", 1)
    rows = [(1, "start " + items[0][1] + " end", "a", "x", 1), (2, "start " + near, "a", "x", 1), (3, "nothing of that sort", "a", "x", 1), (4, None, "a", "x", 1), (5, items[1][1][:30], "a", "x", 1), (6, items[3][1][:30] + " x" * 30 + items[3][1][30:60], "a", "x", 1)]
    benchmark = spark.createDataFrame([*items, (9, None), (10, "short")], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in find_leaks(frame(spark, rows), benchmark).collect()} == {(1, 0), (2, 2)}
    kept = decontaminate(frame(spark, rows), benchmark)
    assert kept.columns == ["doc_id", "text", "source", "row", "words"] and {x[0] for x in kept.collect()} == {3, 4, 5, 6}
    assert decontaminate(frame(spark, rows), benchmark.limit(0)).count() == len(rows)


def test_toxicity(spark):
    rows = [(i, f"a plain text about thing {i} and more", "a", "x", 1) for i in range(60)] + [(100 + i, f"you are a {'frobnik' if i % 2 else 'm0r0n'} and {i}", "a", "x", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(40)] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(frame(spark, rows), labels)
    more = [(1, "Such a frobnik!", "", "", 1), (2, "an іdiоt", "", "", 1), (3, "the clown fish swims", "", "", 1), (4, None, "", "", 1), (5, "", "", "", 1)]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_texts(frame(spark, more), lexicon).collect()}
    assert got[1] >= 0.3 and got[2] >= 0.3 and max(got[3], got[4], got[5]) < 0.3 and min(got.values()) >= 0 and max(got.values()) <= 1
    assert toxicity.learn(frame(spark, rows), labels.limit(0)).weights


def test_toxicity_learns_a_term_rarer_than_many_common_ones(spark):
    r = random.Random(6)
    common = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(13)) for _ in range(2600))
    rows = [(i, common, "a", "x", 1) for i in range(60)] + [(100 + i, f"{common} {'frobnik' if i % 4 else ''}", "a", "x", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(40)], "doc_id long, toxic int")
    assert len(toxicity.terms_of(set(common.split()))) > 20_000
    assert set(toxicity.learn(frame(spark, rows), labels).weights) - {f"{w} " for w in toxicity.SEEDS} == {"frob"}


def test_license_scan(spark):
    rows = [(1, "x\nReleased under the MIT License. Apache License, Version 2.0 CC BY-NC", "a", "x", 1), (2, "This work is licensed under the GNU General Public License, version 3.", "a", "x", 1), (3, None, "a", "x", 1), (4, "under the mit license under the mit license", "a", "x", 1), (5, "under the mit", "a", "x", 1), (6, "license", "a", "x", 1)]
    got = {r["doc_id"]: r for r in license_scan(frame(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["base_labels"], got[1]["first_word"], got[1]["last_word"]) == (3, "apache-2,cc-by-nc,mit", 2, 11)
    assert got[2]["labels"] == "gpl-3" and got[2]["base_labels"] == "" and got[2]["score"] == 1.0
    assert (got[3]["n_words"], got[3]["labels"], got[3]["score"]) == (0, "", 0.0)
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 0, 4)
    assert got[5]["n_base"] == 0 and got[6]["n_base"] == 0


def test_license_scan_of_a_notice_in_half_of_the_documents(spark):
    notices = {"all-rights-reserved": "All rights reserved", "gpl-3": "This work is licensed under the GNU General Public License, version 3", "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License", "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted"}
    for label, notice in notices.items():
        got = license_scan(frame(spark, [(i, f"page {i} {notice if i % 2 else 'nothing'}", "a", "x", 1) for i in range(40)])).collect()
        assert [(r["labels"], r["score"]) for r in sorted(got)] == [("", 0.0), (label, 1.0)] * 20


def test_license_scan_of_several_notices_in_a_file(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    gpl, bsd = "This work is licensed under the GNU General Public License, version 3", "Redistribution and use in source and binary forms, with or without modification, are permitted"
    rows = [(1, f"{mit}. {gpl}", "a", "x", 1), (2, f"All rights reserved. {bsd}", "a", "x", 1), (3, " ".join([mit, gpl, bsd, "All rights reserved"] * 3), "a", "x", 1), (4, "rights reserved. The GNU General Public License", "a", "x", 1)]
    rows += [(10 + i, gpl if i % 2 else "all rights reserved", "a", "x", 1) for i in range(40)]  # so the others' words are rarer
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan(frame(spark, rows)).collect()}
    assert [got[i] for i in range(1, 5)] == [("gpl-3,mit", 1.0), ("all-rights-reserved,bsd", 1.0), ("all-rights-reserved,bsd,gpl-3,mit", 1.0), ("", 0.0)]


@pytest.mark.parametrize("seed", range(4))
def test_license_alignments_equal_brute_force(seed):
    r, index = random.Random(seed), LicenseIndex()
    texts = []
    for _ in range(60):
        words = []
        for _ in range(r.randint(0, 6)):
            body = words_of(r.choice(index.templates).text)
            body = [x if r.random() < 0.9 else r.choice([*index.vocabulary, b"other"]) for x in body[r.randint(0, 2) : len(body) - r.randint(0, 2)]]
            words += body + [b"other"] * r.randint(0, 4)
        texts.append(b" ".join(words))
    w = fw.Words(texts, fw.ALNUM_LOWER, lower=True)
    v = index.numbers(w)
    labels, best = index.align(w, v, index.lookups(np.array([r.random() for _ in index.vocabulary])))
    want_labels, want_best = [set() for _ in texts], np.zeros(len(texts))
    for d in range(len(texts)):
        x = v[w.first[d] : w.first[d + 1]]
        for t, body in enumerate(index.bodies):
            for start in range(-len(body), len(x)):
                lo, hi = max(start, 0), min(start + len(body), len(x))
                fit = float((x[lo:hi] == body[lo - start : hi - start]).sum()) / len(body)
                if fit >= 0.6 and all(len(places(x[max(lo - 3, 0) : hi + 3], k)) for k in index.keys[t]):
                    want_labels[d].add(index.templates[t].label)
                    want_best[d] = max(want_best[d], fit)
    assert labels == want_labels and (best == want_best).all() and any(len(x) > 2 for x in labels)


def test_url_filter(spark):
    urls = ["http://A.example.ORG/x", "https://example.org/es/1", "https://b.example.org/en/12", "http://x.com/fr/?q", "http://x.com/de/1", "http://xcom/fr/", "http://y.org", None, "no scheme", "http://z.net/de/1", "http://z.net/de/1"]
    got = {(r["page_id"]): r for r in url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None, None]
    assert [got[i]["verdict"] for i in range(5)] == ["allow", "block", "block", "allow", "block"]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.org", "/x") and (got[7]["host"], got[8]["path"]) == ("", "")
    assert got[9]["verdict"] == got[10]["verdict"]


def test_words_match_the_contract():
    text = "Aé b\x0bc\x1cd  ÿ z\n"
    w = fw.Words([text.encode()])
    assert [w.text(i).decode() for i in range(len(w.start))] == re.findall(r"[^\x20\x09-\x0D]+", text)
    assert hashlib.sha256(b"").hexdigest()  # the digest of an empty text is defined
