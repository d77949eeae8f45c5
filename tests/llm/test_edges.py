"""Odd rows, extra columns and empty tables of the operators and the pipeline's stages."""

import random
import struct
import time
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import entry, toxicity
from marlstone.llm import decontaminate as dc
from marlstone.llm.jaccard_join import jaccard_groups
from marlstone.llm.license_scan import license_scan
from marlstone.llm.line_dedup import line_dedup
from marlstone.llm.substring_dedup import substring_dedup
from marlstone.llm.topk_search import topk_search
from marlstone.llm.url_filter import url_filter
from marlstone.llm.workspace import unused

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that an operator might use itself, some in another case of letters
CLASHING = "doc_id long, text string, source string, Toxicity double, N_LINES long, n_removed long, host string, row string, lines string, bad string, salt int, id long, n long, component_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS).repartition(2)


def tokenizers():
    return pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_equals_its_sql(spark, name):
    for t in ("documents", "embeddings", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duckdb.sql(entry.ORACLES[name])
    assert sorted(want.columns) == columns
    plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    assert Counter(map(plain, df.select(columns).collect())) == Counter(map(plain, want.select(*columns).fetchall()))


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert topk_search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).count() == 0
    assert dc.find_leaks(none, benchmark).count() == dc.decontaminate(none, benchmark).count() == 0
    assert line_dedup(none).count() == substring_dedup(none).count() == license_scan(none).count() == jaccard_groups(none).count() == 0
    assert toxicity.score_texts(none, toxicity.learn(none, labels)).count() == 0
    assert url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_empty_tables_of_tokens(spark):
    from marlstone.llm.piece_bpe import encode_decode
    from marlstone.llm.token_files import read_token_files, write_token_files

    path = tokenizers().path
    none = docs(spark, [])
    assert encode_decode(none, path("piece_bpe_32k.model")).count() == 0
    assert read_token_files(spark, write_token_files(none, path("byte_bpe_50k.json"), 2)).count() == 0


def test_unused_names():
    assert unused(["a", "Toxicity"], "toxicity") == "toxicity_1" and unused(["n", "n_1"], "N") == "N_2" and unused([], "x") == "x"


def test_clashing_columns_are_kept(spark):
    rows = [(i, f"menu\nown {i}", "a", 0.5, 7, 8, "h", "r", "l", "b", 3, 4, 5, 6) for i in range(8)]
    df = spark.createDataFrame(rows, CLASHING)
    own = {r["doc_id"]: tuple(r)[2:] for r in df.collect()}
    scored = toxicity.score_texts(df, toxicity.Lexicon({"idiot ": 4.0}))
    assert scored.columns == [*df.columns, "toxicity_1"] and {r[0]: tuple(r)[2:-1] for r in scored.collect()} == own
    kept = toxicity.keep_clean(df, toxicity.Lexicon({"idiot ": 4.0}))
    assert kept.columns == df.columns and kept.count() == 8
    lines = line_dedup(df)
    assert lines.columns == [*df.columns, "n_lines_1", "n_removed_1"]
    assert {r[0]: tuple(r)[2:-2] for r in lines.collect()} == own and {tuple(r)[-2:] for r in lines.collect()} == {(2, 1)}
    assert dc.decontaminate(df, spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string")).columns == df.columns
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_groups(df).collect()} == {(i, i) for i in range(8)}
    assert license_scan(df).count() == substring_dedup(df).count() == 8
    leaks = dc.find_leaks(df.withColumns({"item_id": F.lit(1), "edits": F.lit(2), "position": F.lit(3)}), spark.createDataFrame([(1, "menu own 3")], "item_id long, text string"))
    assert [r["doc_id"] for r in leaks.collect()] == [3]


def test_exceptions_take_linear_time():
    lexicon = toxicity.Lexicon({f"{w} ": 4.0 for w in toxicity.SEEDS})
    automaton = lexicon.automaton()
    began = time.time()
    assert lexicon.load(automaton, "trash can " * 200_000) == 0.0
    assert time.time() - began < 20
    assert lexicon.load(automaton, "trash can trash bin trash") > 0


def test_scores_equal_brute_force():
    r = random.Random(3)
    weights = {"idiot ": 4.0, "frob": 2.0, "scum ": 3.0, "trash ": 4.0, "clown ": 1.0}
    lexicon = toxicity.Lexicon(weights)
    automaton = lexicon.automaton()
    vocabulary = ["idiot", "idiots", "frobnik", "afrob", "scum", "trash", "can", "bin", "clown", "fish", "class", "plain"]
    for _ in range(500):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 12))]
        safe = set()
        for k in range(len(words)):
            for phrase in toxicity.EXCEPTIONS:
                p = phrase.split()
                if words[k : k + len(p)] == p:
                    safe |= set(range(k, k + len(p)))
        total = sum(max([w for t, w in weights.items() if (x + " ").startswith(t)], default=0) for k, x in enumerate(words) if k not in safe)
        want = toxicity.math.log1p(100 * total / (max(len(words), 1) + 1 + 50)) if total else 0.0
        assert lexicon.load(automaton, " ".join(words)) == pytest.approx(want), words


def test_toxicity_of_ties_repeats_and_null_ids(spark):
    rows = [(1, "an idiot"), (1, "an idiot"), (None, "an idiot"), (2, None), (3, "")]
    got = [tuple(r)[-1] for r in toxicity.score_texts(docs(spark, rows), toxicity.Lexicon({"idiot ": 4.0})).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[2] and got[3] == got[4] < 0.3 and len(got) == 5


def edits_within(items, text):
    """Fewest edits between an item's segments and any stretch of the text, by the plain table."""
    best = {}
    for i, item in items:
        codes, flat = dc.fold(item), dc.fold(text)
        if len(codes) < dc.Q:
            if len(codes) and codes.tolist() == flat.tolist():
                best[i] = 0
            continue
        last = max(len(codes) - dc.SEGMENT, 0)
        for s in {*range(0, last + 1, dc.SEGMENT // 2), last}:
            part = codes[s : s + dc.SEGMENT].tolist()
            row = [0] * (len(flat) + 1)
            for k, c in enumerate(part, 1):
                new = [k]
                for j, x in enumerate(flat.tolist(), 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
                row = new
            allowed = min(int(len(part) * dc.BUDGET), (len(part) - dc.Q) // dc.Q)
            if min(row) <= allowed:
                best[i] = min(best.get(i, 10**9), min(row))
    return best


def test_decontamination_equals_brute_force(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 6, 10, 20, 40, 60])] + [(20, "yes"), (21, None), (22, "  ")]
    rows = []
    for d in range(90):
        _, item = r.choice([x for x in items if x[1]])
        x = list(item)
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            at = r.randrange(len(x) + 1)
            x[at : at + r.choice([0, 1])] = [r.choice("abcdexyz")] * r.choice([0, 1])
        around = [" ".join(word() for _ in range(r.choice([0, 3]))) for _ in range(2)]
        rows.append((d, f"{around[0]} {''.join(x)} {around[1]}"))
    rows += [(100, "Yes!"), (101, "yes sir"), (102, None), (103, ""), (None, items[5][1]), (5, rows[5][1])]
    got = {}
    for x in dc.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault(x["doc_id"], {})[x["item_id"]] = x["edits"]
    want = {d: e for d, t in rows if (e := edits_within([x for x in items if x[1]], t or ""))}
    assert got == want and got[100] == {20: 0} and 101 not in got and None in got


def test_a_short_item_and_a_very_long_text(spark):
    item = "what is the sun made of"
    rows = [(1, "so " + item + "?"), (2, "filler words go on and on " * 20_000 + item), (3, "what is the moon made of")]
    got = dc.find_leaks(docs(spark, rows), spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")).collect()
    assert {(x["doc_id"], x["edits"]) for x in got} == {(1, 0), (2, 0)} and len(got) == 2


def test_line_dedup_by_salted_join_and_long_text(spark):
    rows = [(i, f"menu\nown {i}") for i in range(30)] + [(100, "long\n" * 100_000 + "menu")]
    one, two = (sorted(map(tuple, line_dedup(docs(spark, rows), broadcast_lines=n).collect())) for n in (10**6, -1))
    assert one == two and all("menu" not in r[1] for r in one) and len(one) == 31


def test_token_files_of_repeated_and_null_ids(spark):
    from tokenizers import Tokenizer

    from marlstone.llm.token_files import read_token_files, write_token_files

    path = tokenizers().path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [(None, "a null id"), (None, "another"), (7, "x's, they're 'll"), (7, "x's, they're 'll"), (7, ""), (8, None), (9, "Жук 日本 １２　end <|endoftext|>"), (10, "word " * 50_000)]
    got = read_token_files(spark, write_token_files(docs(spark, texts), path, 2)).collect()
    crc = lambda t: zlib.crc32(struct.pack(f"<{len(i := [*library.encode(t or '', add_special_tokens=False).ids, 2])}I", *i))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, crc(t)) for i, t in texts)
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    assert [r["doc_id"] for r in rows] == [None, None, 7, 7, 7, 8, 9, 10]


def test_pieces_equal_the_library():
    from tokenizers import Tokenizer

    from marlstone.llm import pieces as px
    from marlstone.llm.token_files import Encoder

    import pyarrow as pa

    path, r = tokenizers().path("byte_bpe_50k.json"), random.Random(4)
    library, ours = Tokenizer.from_file(path), Encoder(path)
    texts = ["".join(r.choice("aabestTmrlvd''''   \n\té日本漢.,!0123½²Яжا") for _ in range(r.randint(0, 40))) for _ in range(4000)]
    flat, n = ours(px.text_column(pa.array(texts)))
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_known_pieces_are_not_encoded_again():
    import pyarrow as pa

    from marlstone.llm.token_files import Encoder

    words = ["".join("abcdefghij"[int(d)] for d in f"{i:06}") for i in range(950_000)]
    column = pa.array([" " + " ".join(words[i : i + 50_000]) for i in range(0, len(words), 50_000)])
    ours, seen = Encoder(tokenizers().path("byte_bpe_50k.json")), []
    encode = ours.memo.encode
    ours.memo.encode = lambda new: (seen.append(len(new)), encode(new))[1]
    one, two = ([ours(column.slice(i, 1)) for i in range(len(column))] for _ in range(2))
    assert sum(seen) == len(words)  # all of them in the first pass
    assert all((a == b).all() for x, y in zip(one, two, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("known, slots", [(1, 2), (40, 64), (1 << 10, 1 << 11)])
def test_known_pieces_of_full_tables(known, slots):
    import numpy as np
    import pyarrow as pa

    from marlstone.llm import pieces as px

    def encode(new):  # the bytes of a piece and one more id
        parts = [[*b, 256 + len(b)] for b in new.to_pylist()]
        return np.array([i for p in parts for i in p], np.int32), np.array([len(p) for p in parts], np.int64)

    r, table = random.Random(5), px.Known(encode, known, slots)
    for _ in range(30):
        words = [bytes(r.choice(b"\0\0ab") for _ in range(r.choice((1, 2, 3, 7, 8, 9, 14, 15, 16, 17, 70)))) for _ in range(r.randint(0, 60))]
        cut = sorted(r.choices(range(len(words) + 1), k=3))
        per_text = np.diff([0, *cut, len(words)])
        ids, n = table.ids(pa.array(words, pa.binary()), per_text)
        texts = [words[a:b] for a, b in zip([0, *cut], [*cut, len(words)], strict=True)]
        assert ids.tolist() == encode(pa.array(words, pa.binary()))[0].tolist()
        assert n.tolist() == [sum(len(w) + 1 for w in t) for t in texts]


def test_jaccard_groups_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, "other words entirely here now"), (9, text), (9, text), (11, ""), (12, None), (13, "two words"), (14, "two words")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_groups(docs(spark, rows)).collect())
    assert got == Counter([(None, 27, None), (5, 27, 5), (5, 2, 5), (9, 27, 5), (9, 27, 5), (11, 0, 11), (12, 0, 12), (13, 1, 13), (14, 1, 13)])


def test_url_filter_of_long_and_shuffled(spark, monkeypatch):
    from marlstone.llm import url_filter as module

    urls = [f"http://a{i}.org/{'good' * 3}{i}" for i in range(20)] + [f"http://b{i}.com/de/{'bad' * 3}{i}" for i in range(20)] + ["http://c.net/x?" + "bad" * 10_000, "http://c.net/x?goodgood", "http://c.net/x?badbad", None, "plain"]
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, read string")
    one = sorted(map(tuple, url_filter(df).collect()), key=str)
    monkeypatch.setattr(module, "BROADCAST_RUNS", -1)
    assert sorted(map(tuple, url_filter(df).collect()), key=str) == one
    verdict = {r[0]: r[4] for r in one}
    assert verdict[40] == "block" and verdict[41] == "allow" and verdict[42] == "block"  # only the query tells


# --- the pipeline ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Small tables with a toxic document, boilerplate, copies, a benchmark passage and odd rows."""
    r = random.Random(2)
    vocabulary = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = say(40)
    rows = [(i, f"the same old menu\n{say(60)}", "en", f"s{i % 2}", 0, 0.5, 9) for i in range(1, 40)]
    base = rows[3][1]
    rows += [(50, base, "en", "s1", 0, 0.5, 9), (51, base.rsplit(" ", 1)[0] + " changed", "en", "s1", 0, 0.5, 9), (60, f"{say(20)} {passage} {say(20)}", "en", "s0", 0, 0.5, 9)]
    rows += [(70 + k, f"you idiot moron scum {say(5)}", "en", "s0", 0, 0.5, 9) for k in range(3)]
    rows += [(80, None, None, None, None, None, None), (81, "", "en", "s0", 0, 0.5, 9), (None, say(30), "en", "s0", 0, 0.5, 9), (82, "long " + say(20_000), "en", "s0", 0, 0.5, 9)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity double, n_lines long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def stage(spark, sf, name, df):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name](spark, df, sf).cache()


def test_every_stage(spark, sf):
    import corpus_pipeline

    df = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda x: Counter(r["doc_id"] for r in x.select("doc_id").collect())
    clean = stage(spark, sf, "toxicity", df)
    assert ids(df) - ids(clean) == Counter([70, 71, 72])
    lines = stage(spark, sf, "line_dedup", df)
    assert ids(lines) == ids(df) and not lines.filter("text LIKE '%same old menu%'").count()
    assert lines.filter("coalesce(length(text), 0) <> n_chars").count() == 0 and lines.filter("doc_id = 80 AND text IS NULL").count() == 1
    copies, passages = stage(spark, sf, "ngram_jaccard_join", df), stage(spark, sf, "benchmark_decontamination", df)
    assert ids(df) - ids(copies) == Counter([50, 51])
    assert ids(df) - ids(passages) == Counter([60])
    for out in (clean, lines, copies, passages):
        assert out.columns == df.columns
        assert {(r["toxicity"], r["n_lines"]) for r in out.collect()} == {(0.5, 9), (None, None)}
    tokens = stage(spark, sf, "sentencepiece", df)
    assert ids(tokens) == ids(df) and tokens.filter("doc_id IN (80, 81)").select("n_tokens", "ids").distinct().collect() == [(1, "2")]


def test_every_stage_of_an_empty_table(spark, sf):
    import corpus_pipeline

    for _, f in corpus_pipeline.STAGES:
        assert f(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0


def test_the_pipeline_is_its_stages(spark, sf):
    import corpus_pipeline

    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect())
    everything = Counter(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert everything - got == Counter([50, 51, 60, 70, 71, 72]) and not got - everything
