"""The corpus operators against plain Python on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelwright.llm import components, decontaminate, exact_dedup, jaccard_join, language_id, sentence_pieces, sharding, substring_dedup, token_files, toxicity, url_filter
from panelwright.llm.common import new_path

SPACES = "[\x20\x09-\x0d]+"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark, rows, partitions=3):
    """documents with columns that clash with names the operators use inside."""
    wide = [(i, t, "x", 1, 2, "k", "v") for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, h string, n int, row int, keep string, id string").repartition(partitions)


def odd_rows():
    rng = random.Random(7)
    pool = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choice(pool) for _ in range(60))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Two words"), (5, "two  words"), (6, "Two\nwords ")]
    for i in range(7, 40):
        text = " ".join(rng.choice(pool) for _ in range(rng.choice([3, 12, 40, 90])))
        if i % 3 == 0:
            text += "\n" + passage
        rows.append((i, text))
    rows += [(40, rows[8][1]), (41, rows[8][1] + "  "), (42, rows[8][1]), (42, rows[8][1]), (None, rows[9][1]), (43, "Ünïcode wörd " * 900)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


def test_exact_groups(spark, rows):
    found = exact_dedup.exact_groups(docs_of(spark, rows, 5)).collect()
    norm = [(i, re.sub(SPACES, " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    expected = []
    for i, t in norm:
        known = [x for x in groups[t] if x is not None]
        expected.append((i, min(known) if known else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    key = lambda r: (r[3], r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=key) == sorted(expected, key=key)
    assert sum(r.kept for r in found) == len(groups)
    kept = exact_dedup.exact_dedup(docs_of(spark, rows))
    assert kept.count() == len(groups) and kept.columns[:2] == ["doc_id", "text"]
    assert exact_dedup.exact_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_a_text_over_many_partitions(spark):
    many = [(i, "same") for i in range(500)] + [(i, f"own {i}") for i in range(500, 600)]
    found = exact_dedup.exact_groups(docs_of(spark, many, 6)).where("doc_id < 500")
    assert found.agg(F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.sum(F.col("kept").cast("int"))).first() == (0, 0, 500, 1)


def test_a_text_of_many_pieces(spark, monkeypatch):
    """A text that most rows share never stands in a task as a whole."""
    monkeypatch.setattr(exact_dedup, "OUT_ROWS", 16)
    many = [(i, "same  text") for i in range(400)] + [(400 + i, f"own {i % 40}") for i in range(80)] + [(None, "same text")] * 3
    found = exact_dedup.exact_groups(docs_of(spark, many, 4))
    assert found.where("doc_id < 400").agg(F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.sum(F.col("kept").cast("int"))).first() == (0, 0, 403, 1)
    assert found.count() == 483 and found.where("kept").count() == 41


def plain_repeats(rows, window):
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    seen = {}
    for n, (_, w) in enumerate(words):
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), []).append((n, k))
    out = []
    for n, (i, w) in enumerate(words):
        gone = set()
        for k in range(len(w) - window + 1):
            if len(seen[tuple(w[k : k + window])]) > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [35, 50, 8])
def test_substring_dedup(spark, rows, window):
    found = substring_dedup.drop_repeats(docs_of(spark, rows), window)
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain_repeats(rows, window)


def test_substring_dedup_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_ROWS", 7)
    passage = " ".join(f"p{k}" for k in range(50))
    many = [(i, f"a{i} {passage} b{i}") for i in range(60)] + [(60, " ".join(f"q{k}" for k in range(50)))]
    found = substring_dedup.drop_repeats(docs_of(spark, many), with_text=True)
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in found.collect())[:60] == [(i, 50, f"a{i} b{i}") for i in range(60)]
    assert substring_dedup.drop_repeats(docs_of(spark, many).limit(0)).count() == 0


def shingles_of(rows, size):
    sets = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").encode().lower().decode())
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    return sets


def plain_components(rows, num, den, size):
    sets = shingles_of(rows, size)
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                label[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k))) for k, (i, s) in enumerate(sets)), key=str)


def near_rows():
    rng, rows = random.Random(11), []
    for group in range(12):
        n = rng.choice([4, 11, 14, 25, 40, 120, 300])
        base = [f"g{group}x{k}" for k in range(n)]
        for _ in range(10):
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                own[rng.randrange(len(own))] = f"new{rng.random()}"
            if rng.random() < 0.3:
                own = own[: len(own) - rng.randint(0, max(1, n // 20))]
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("num,size,tile,links", [(90, 3, 1 << 18, False), (80, 5, 1 << 18, True), (90, 3, 600, False), (80, 3, 600, True)])
def test_jaccard_groups(spark, monkeypatch, rows, num, size, tile, links):
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", tile)  # small tiles cut groups
    every = near_rows() + [(None if i is None else i + 1000, t) for i, t in rows]
    found = jaccard_join.jaccard_groups(docs_of(spark, every), num, 100, size, with_links=links).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == plain_components(every, num, 100, size)
    if links:
        sets = [s for _, s in shingles_of(every, size)]
        count = lambda x: sum(bool(x and y) and 100 * len(x & y) >= num * len(x | y) for y in sets) - bool(x)
        assert sorted(((r.doc_id, r.n_links) for r in found), key=str) == sorted(((i, count(s)) for (i, _), s in zip(every, sets, strict=True)), key=str)


def test_a_group_of_many_tiles(spark, monkeypatch):
    """Near copies connect in the dealt tiles; a template whose fillings are too far apart stays apart."""
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", 4_000)
    monkeypatch.setattr(jaccard_join, "LEAST_WEIGHT", 100)
    base = [f"w{k}" for k in range(120)]
    near = [(k, " ".join([*base[:k], f"own{k}", *base[k + 1 :]])) for k in range(100)]
    form = [(200 + k, " ".join([*(f"t{j}" for j in range(100)), *(f"f{k}x{j}" for j in range(12))])) for k in range(60)]
    in_tiles, sizes = jaccard_join._in_tiles, []
    monkeypatch.setattr(jaccard_join, "_in_tiles", lambda own, placed, *a: sizes.append(placed.groupBy("tile").agg(F.sum("weight")).agg(F.max("sum(weight)")).first()[0]) or in_tiles(own, placed, *a))
    found = jaccard_join.jaccard_groups(docs_of(spark, near + form)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == plain_components(near + form, 90, 100, 3)
    assert {r.component_id for r in found if r.doc_id < 200} == {0}
    assert all(s < 4 for s in sizes if s)


def thue_morse(size):
    out = "a"
    while len(out) < size:
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_polynomial_hashes(spark):
    x, y = thue_morse(1024)
    lead = " ".join(f"w{k}" for k in range(34))
    found = substring_dedup.drop_repeats(docs_of(spark, [(1, f"{lead} {x}"), (2, f"{lead} {y}")]))
    assert [r.n_removed for r in found.collect()] == [0, 0]
    found = jaccard_join.jaccard_groups(docs_of(spark, [(1, x), (2, y), (3, f"{x} a b {y} a b")]), 90, 100, 3).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(1, 1, 1), (2, 1, 2), (3, 4, 3)}


def test_near_dedup_keeps_one(spark):
    rows = near_rows()
    kept = jaccard_join.near_dedup(docs_of(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain_components(rows, 90, 100, 3)})
    assert jaccard_join.jaccard_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_near_dedup_with_null_and_repeated_ids(spark):
    def near(name):
        words = [f"{name}{k}" for k in range(60)]
        return " ".join(words), " ".join([*words[:-1], "other"])

    (a, a2), (b, b2), (c, c2), (d, d2) = (near(x) for x in "abcd")
    rows = [(7, a), (7, a2), (7, "seven has a clean one too"), (None, b), (None, b2), (None, "null has a clean one too"), (None, None), (None, "")]
    rows += [(8, c), (8, c), (8, c2), (9, c), (6, d), (6, d), (5, d2), (5, ""), (5, "")]
    kept = jaccard_join.near_dedup(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    groups = {a: "a", a2: "a", b: "b", b2: "b", c: "c", c2: "c", d: "d", d2: "d"}
    found = sorted(((r.doc_id, groups.get(r.text, r.text)) for r in kept.collect()), key=str)
    expected = [(7, "a"), (7, rows[2][1]), (None, "b"), (None, rows[5][1]), (None, None), (None, ""), (8, "c"), (5, "d"), (5, ""), (5, "")]
    assert found == sorted(expected, key=str)


def test_part_keys_miss_no_link():
    rng = np.random.default_rng(2)
    for n in [*range(1, 40), 77, 250, 900, 5000]:
        for num in (70, 80, 90):
            for _ in range(12):
                a = rng.integers(0, 2**64, n, dtype=np.uint64)
                change = rng.integers(0, max(2, n // 5))
                b = np.concatenate([a[change:], rng.integers(0, 2**64, rng.integers(0, change + 1), dtype=np.uint64)])
                a, b = np.unique(a), np.unique(b)
                both = len(np.intersect1d(a, b))
                hot = rng.integers(0, 256, jaccard_join.PLACES // 8, dtype=np.uint8) & rng.integers(0, 256, jaccard_join.PLACES // 8, dtype=np.uint8)
                if len(b) and 100 * both >= num * (len(a) + len(b) - both):
                    for x, y in ((a, b), (jaccard_join.moved(a, hot), jaccard_join.moved(b, hot))):
                        assert np.intersect1d(jaccard_join.part_keys(x, num, 100), jaccard_join.part_keys(y, num, 100)).size


def test_part_keys_need_no_counts():
    """However large the corpus, rows meet only if a part is the same: here 60 of 300 shingles are in all of 2,000 rows."""
    rng = np.random.default_rng(3)
    common, seen = rng.integers(0, 2**64, 60, dtype=np.uint64), {}
    for k in range(2000):
        own = np.unique(np.concatenate([common, rng.integers(0, 2**64, 240, dtype=np.uint64)]))
        for key in jaccard_join.part_keys(own, 90, 100).tolist():
            seen.setdefault(key, set()).add(k)
    assert max(map(len, seen.values())) <= 17


INSIDE = "id text h n row rows print keys map near node root band tile block label weight class cells i j key rule verdict host path x at token len s pos words tries start known words_ hits own bin part piece edge head keep kept sha lead shard depth prefix cell n_bytes doc first again window more deal anchor anchors spots starts spot gone_id gone_hash gone_again own_hash gone_sha own_sha gone_same row_order bad_id bad_hash lang lang_pred score rejected p_toxic toxic k features n_pieces pieces round_trip ids_crc32 __h __id __sha __text __own part_start n_tokens tokens base".split()


def clashing(spark, rows, id_col="doc_id", text_col="text"):
    names = [n for n in INSIDE if n not in (id_col, text_col)]
    return spark.createDataFrame([(i, t, *[f"v{k}" for k in range(len(names))]) for k, (i, t) in enumerate(rows)], f"{id_col} long, {text_col} string, " + ", ".join(f"`{n}` string" for n in names))


def test_columns_with_the_names_used_inside(spark):
    """All ten operators give the same for a table that has every name they use inside as a column."""
    rows = [(1, "the first text of a few words here"), (2, "the first text of a few words here"), (2, "another"), (None, None), (3, "")]
    bare = spark.createDataFrame(rows, "doc_id long, text string")
    wide = clashing(spark, rows)
    items = spark.createDataFrame([(7, "first text of a few")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    lang = language_id.fit(bare.withColumn("lang", F.lit("xx")))
    chain = toxicity.fit(bare, labels, {"toxic": F.col("toxic")})

    def tokens(docs):
        path = new_path(spark, "tokens")
        token_files.write_tokens(docs, path, TOKENIZER, 1)
        return token_files.token_digests(token_files.read_tokens(spark, path))

    made = {
        "op1": tokens,
        "op2": lambda d: sharding.assign_shards(d, 20),
        "op3": lambda d: substring_dedup.drop_repeats(d, 5),
        "op4": lambda d: language_id.predict(d, lang),
        "op6": lambda d: sentence_pieces.encode_pieces(d, PIECES),
        "op7": exact_dedup.exact_groups,
        "op8": lambda d: jaccard_join.jaccard_groups(d).drop("row_no", "head", "again"),
        "op9": lambda d: decontaminate.contamination(d, items),
        "op10": lambda d: toxicity.score(d, chain),
    }
    for name, operator in made.items():
        assert sorted(map(str, operator(wide).collect())) == sorted(map(str, operator(bare).collect())), name
    kept = {
        "op4": lambda d: language_id.keep_known(d, lang),
        "op7": exact_dedup.exact_dedup,
        "op8": jaccard_join.near_dedup,
        "op9": lambda d: decontaminate.decontaminate(d, items),
    }
    for name, stage_ in kept.items():
        found = stage_(wide)
        assert found.columns == wide.columns, name
        assert sorted((str(r.doc_id), str(r.text)) for r in found.collect()) == sorted((str(r.doc_id), str(r.text)) for r in stage_(bare).collect()), name
        assert set(found.collect()) <= set(wide.collect())
    path = new_path(spark, "shards")
    name = sharding.write_shards(wide, path, 20)
    assert name == "_shard"
    assert sorted(map(str, sharding.read_shards(spark, path, wide, name).drop(name).collect())) == sorted(map(str, wide.collect()))
    urls = [(1, "http://a.net/x"), (2, None)]
    rules = url_filter.rule_table(spark, url_filter.RULES)
    wide_urls = clashing(spark, urls, "page_id", "url")
    assert sorted(map(str, url_filter.filter_urls(wide_urls, rules).collect())) == sorted(map(str, url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()))


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (103, 101), (7, 7), (5, 2), (2, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 31)} | {101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(url_filter.UPPER, url_filter.LOWER)


def plain_contamination(docs, items):
    items = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in items]
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOWER)), set(), set()
        for i, own in items:
            for k in range(max(1, len(own) - 12) if own else 0):
                win = own[k : k + 13]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        if i is not None:
                            found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("the of Éa éa abc x9 q".split()) + rng.choice(["", "s", "ing", "ed"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 6, 13, 14, 30])))) for k in range(14)]
    items += [(20, None), (21, "--- !"), (22, items[3][1]), (None, " ".join(word() for _ in range(15)))]
    docs = [(0, None), (1, ""), (2, "!!")]
    for k in range(3, 60):
        parts = [" ".join(word() for _ in range(rng.choice([0, 5, 60])))]
        if k % 2:
            own = (rng.choice(items)[1] or "").upper().split()
            cut = rng.choice([0, 0, 1])
            parts.append(", ".join(own[cut:]))
        docs.append((k, ". ".join(parts)))
    docs += [(59, docs[-1][1]), (None, items[6][1]), (61, items[5][1] + " İstanbul ΑΣ.Α K")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs_of(spark, docs), frame)
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain_contamination(docs, items)
    assert decontaminate.contamination(docs_of(spark, docs), frame.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs_of(spark, docs).limit(0), frame).count() == 0
    clean = {r[0] for r in plain_contamination(docs, items) if not r[5]} - {r[0] for r in plain_contamination(docs, items) if r[5]}
    assert {r.doc_id for r in decontaminate.decontaminate(docs_of(spark, docs), frame).collect()} == clean


@pytest.mark.parametrize("bound", [0, 10**6])
def test_contamination_by_a_large_and_templated_benchmark(spark, monkeypatch, bound):
    """Tokens over the broadcast bound go by a Bloom filter; windows that share their rarest token are tried once a place."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    form = " ".join(f"f{k}" for k in range(12))
    items = [(k, f"{form} answer{k} end") for k in range(300)] + [(1000, "one"), (1001, "two words")]
    docs = [(k, f"a {form} answer{k} end b") for k in range(0, 60, 7)] + [(100, form), (101, f"{form} other end"), (102, "one two words"), (103, None)]
    found = decontaminate.contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain_contamination(docs, items)


def test_decontaminate_with_null_and_repeated_ids(spark):
    item = " ".join(f"bench{k}" for k in range(20))
    frame = spark.createDataFrame([(1, item)], "item_id long, text string")
    bad = [(7, f"some {item}"), (7, f"some {item}"), (None, f"more {item}"), (9, item)]
    good = [(7, "seven has a clean one too"), (7, "seven has a clean one too"), (None, "null has a clean one too"), (None, None), (7, ""), (8, "eight")]
    kept = decontaminate.decontaminate(docs_of(spark, bad + good), frame)
    assert kept.columns == docs_of(spark, good).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(good, key=str)


def test_token_files(spark, rows):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(TOKENIZER)
    every = rows + [(50, "Don't <|endoftext|> <|ENDOFTEXT|> é\u0301 É×÷ 12 +=-"), (51, "a***" * 50)]
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs_of(spark, every), path, TOKENIZER, end_id=1)
    found = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digests(token_files.read_tokens(spark, path)).collect()), key=lambda r: r[1])
    expected, start = [], 0
    ids = {}
    for i, t in every:
        ids.setdefault(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    for i in sorted((i for i, _ in every if i is not None)) + [None]:
        raw = np.asarray(ids[i], dtype="<u4").tobytes()
        expected.append((i, start, len(ids[i]), zlib.crc32(raw)))
        start += len(ids[i])
    assert found == expected
    meta = token_files.read_metadata(spark, path)
    assert "tokens" not in meta.columns and meta.agg(F.sum("n_tokens")).first()[0] == start
    one = token_files.read_tokens(spark, path, F.col("doc_id") == 7).collect()
    assert [list(r.tokens) for r in one] == [ids[7]]


def test_token_files_of_another_tokenizer_and_their_layout(spark, rows):
    """A tokenizer that merges across spaces takes whole texts; the files have the encodings, row groups and page indexes asked for."""
    import glob

    import pyarrow.parquet as pq
    import tokenizers

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.word_ids(other).whole and not token_files.word_ids(TOKENIZER).whole
    tokenizer, path = tokenizers.Tokenizer.from_file(other), new_path(spark, "tokens")
    token_files.write_tokens(docs_of(spark, rows), path, other, end_id=1)
    texts = dict(rows)
    for r in token_files.read_tokens(spark, path).collect():
        assert list(r.tokens) == tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
    for name in glob.glob(path.removeprefix("file://") + "/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings and "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_word_ids_equal_whole_texts():
    import tokenizers

    tokenizer, words, rng = tokenizers.Tokenizer.from_file(TOKENIZER), token_files.WordIds(TOKENIZER), random.Random(1)
    alpha = list("abZÉéßÀ×÷'sdtlmre.,;:!?|*%_[]  \n\t\u0338\u0301=\xa0İıKΣσς漢1٣²-<|>") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "Don't "]
    for _ in range(3000):
        text = "".join(rng.choice(alpha) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(words.text(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("limit", [50, 700, 10**9])
def test_shards(spark, rows, limit):
    found = sharding.assign_shards(docs_of(spark, rows), limit).collect()
    assert len(found) == len(rows)
    size = {}
    for r in found:
        size.setdefault(r.shard, []).append(r.n_bytes)
    for r in found:
        own = size[r.shard]
        assert (r.shard_bytes, r.shard_rows) == (sum(own), len(own)) and (sum(own) <= limit or len(own) == 1)
        if "." not in r.shard:
            bits = bin(int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
            assert r.shard in ("-", bits[: r.depth])
            if r.depth:  # the bucket above was too large
                above = sum(x.n_bytes for x in found if (bin(int(hashlib.md5(("" if x.doc_id is None else str(x.doc_id)).encode()).hexdigest()[:15], 16))[2:].zfill(60)).startswith(bits[: r.depth - 1]))
                assert above > limit
    assert sharding.assign_shards(docs_of(spark, rows).limit(0), limit).count() == 0


def test_shards_of_one_repeated_id(spark):
    found = sharding.assign_shards(docs_of(spark, [(1, "x" * 10)] * 40), 100)
    assert found.agg(F.max("shard_bytes"), F.count("*")).first()[1] == 40 and found.agg(F.max("shard_bytes")).first()[0] <= 100


@pytest.mark.parametrize("limit", [100, 10**9])
def test_written_shards_hold_every_row_once(spark, rows, limit):
    every = rows + [(1, "x" * 10)] * 30 + [(None, "y" * 10)] * 30 + [(None, None)]
    path = new_path(spark, "shards")
    sharding.write_shards(docs_of(spark, every), path, limit)
    found = spark.read.parquet(path).withColumn("at", F.regexp_extract(F.col("_metadata.file_path"), "/shard=([^/]+)/", 1))
    assert found.drop("at", "shard").columns == docs_of(spark, every).columns
    found = found.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(every, key=str)
    size = {}
    for r in found:
        size.setdefault(r["at"], []).append(len((r.text or "").encode()))
    assert all(sum(own) <= limit or len(own) == 1 for own in size.values())
    assert (len(size) > 1) == (limit == 100)


def test_urls(spark):
    urls = ["http://Example.NET/en/x", "https://a.b.example.net/enx", "http://net/", "http://net", "http://notnet/", "http://x.example.com/de/?q", "http://example.com?/de/", "http://example.com#/de/", "http://q.org/fr/a://net/", None, "", "no scheme", "http://[::1]/a", "://net/\n", "http://example.net/en/x"]
    frame = spark.createDataFrame([(k, u, "z", "z") for k, u in enumerate(urls)], "page_id long, url string, key string, rule string")
    found = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(frame, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    for k, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0].translate(LOWER)
            path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=(0, None, "allow"))
        assert found[k] == (host, path, best[1], best[2]), url
    none = url_filter.filter_urls(frame, url_filter.rule_table(spark, []))
    assert none.where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
    assert url_filter.filter_urls(frame.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_many_rules_pass_the_bloom_filter(spark):
    rules = [("block", f"h{k}.com/p{k}/") for k in range(500)]
    frame = spark.createDataFrame([(k, f"http://www.h{k}.com/p{k}/x") for k in range(1000)], "page_id long, url string")
    found = url_filter.filter_urls(frame, url_filter.rule_table(spark, rules))
    assert found.where("verdict = 'block'").count() == 500 == found.where("page_id < 500 AND rule IS NOT NULL").count()


def language_rows():
    rng = random.Random(5)
    stems = {"en": ["the", "ing", "th", "wh", "and"], "de": ["der", "sch", "ung", "ein", "ich"], "fr": ["eau", "oi", "que", "les", "é"]}
    return [(k, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(rng.choice([2, 20]))), lang) for k in range(120) for lang in [rng.choice(list(stems))]]


def test_language_id(spark):
    rows = language_rows()
    frame = spark.createDataFrame([*rows, (200, None, "en"), (201, "123 !", "en"), (202, "", None), (203, "漢字仮名", None)], "doc_id long, text string, lang string")
    model = language_id.fit(frame.where(~language_id.held_out()))
    found = {r.doc_id: r for r in language_id.predict(frame, model).collect()}
    assert sum(found[k].lang_pred == lang for k, _, lang in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in found.values())
    for k in (200, 201, 202):
        assert (found[k].lang_pred, found[k].score, found[k].rejected) == ("und", 0.0, True)
    assert found[203].lang_pred in ("en", "de", "fr") and found[203].rejected
    assert {r.doc_id for r in language_id.keep_known(frame, model).collect()} == {k for k, r in found.items() if not r.rejected}
    empty = language_id.fit(frame.limit(0))
    assert {r.lang_pred for r in language_id.predict(frame, empty).collect()} == {"und"}
    assert language_id.predict(frame.limit(0), model).count() == 0


def test_language_id_held_out(spark):
    """On the given tables: right on rows that weren't learned from; a language that wasn't learned is rejected, known ones aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rest = docs.where(language_id.held_out())
    found = language_id.predict(rest, language_id.fit(docs.where(~language_id.held_out()))).join(rest.select("doc_id", "lang"), "doc_id")
    n, right, refused = found.agg(F.count("*"), F.count_if(F.expr("lang_pred = lang")), F.count_if("rejected")).first()
    assert right >= 0.98 * n and refused <= 0.02 * n
    for gone in ("en", "fr"):
        model = language_id.fit(docs.where(~language_id.held_out() & (F.col("lang") != gone)))
        found = language_id.predict(rest, model).join(rest.select("doc_id", (F.col("lang") == gone).alias("gone")), "doc_id")
        seen = {r.gone: (r.n, r.refused) for r in found.groupBy("gone").agg(F.count("*").alias("n"), F.count_if("rejected").alias("refused")).collect()}
        assert seen[True][1] >= 0.9 * seen[True][0] and seen[False][1] <= 0.02 * seen[False][0]


def test_language_ties_take_the_first_language():
    model = {"langs": ["aa", "bb"], "idf": np.ones(language_id.DIMENSIONS, np.float32), "centroids": np.ones((2, language_id.DIMENSIONS), np.float32) / language_id.DIMENSIONS**0.5, "bounds": np.zeros(2)}
    near, _, rejected = language_id.judge(["some words", None, "12"], model)
    assert near.tolist() == [0, -1, -1] and rejected.tolist() == [False, True, True]


def test_language_id_rejects_unlearned_languages_in_known_letters(spark):
    frame = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    other = ["Chiudere le finestre e scendere in strada, dove il vento scherza con le foglie secche", "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura", "Minä olen suomalainen ja asun pienessä kaupungissa", "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0"]
    short = ["theingth", "the wh", "dereinich", "sch ung", "eau", "queoiles é", "der"]
    docs = spark.createDataFrame([*enumerate(other), *enumerate(short, 100)], "doc_id long, text string")
    assert {r.doc_id for r in language_id.predict(docs, model).where("rejected").collect()} == set(range(len(other)))
    assert {r.text for r in language_id.keep_known(docs, model).collect()} == set(short)
    assert language_id.keep_known(frame, model).count() == frame.count()


def test_pieces_are_the_best_path():
    model, rng = sentence_pieces.pieces_of(PIECES), random.Random(9)
    score = {i: s for _, (n, i, s) in ((w, model.automaton.get(w)) for w in model.automaton.keys())}
    index = {w: model.automaton.get(w)[1] for w in model.automaton.keys()}

    def best(text):
        found = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 40), end):
                piece = text[start:end]
                gain = score[index[piece]] if piece in index else model.floor if end - start == 1 else None
                if gain is not None:
                    found[end] = max(found[end], found[start] + gain)
        return found[-1]

    def worth(ids):
        total, k, own = 0.0, 0, ids
        while k < len(own):
            if own[k] in model.bytes.values():
                raw = b""
                while True:
                    raw += model.plain[own[k]]
                    k += 1
                    try:
                        raw.decode()
                        break
                    except UnicodeDecodeError:
                        continue
                total += model.floor
            else:
                total += score[own[k]]
                k += 1
        return total

    for _ in range(60):
        text = "".join(rng.choice(["the", "ing", " ", "  ", "é", "漢", "\n", "x", "Z", "12", ".", "🙂"]) for _ in range(rng.randint(1, 25)))
        ids = np.frombuffer(model.encode(text), "<i4").tolist()
        assert worth(ids) == pytest.approx(best(sentence_pieces.MARK + text.replace(" ", sentence_pieces.MARK)))
        assert model.decode(model.encode(text)).decode() == text


def test_encode_pieces(spark, rows):
    import sentencepiece

    found = sentence_pieces.encode_pieces(docs_of(spark, rows), PIECES)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {i: t or "" for i, t in rows}
    for r in found.collect():
        assert r.round_trip and len(r.pieces) == r.n_pieces and lib.decode(list(r.pieces)) == texts[r.doc_id]
    back = sentence_pieces.decode_pieces(found, PIECES)
    assert all(r.text == texts[r.doc_id] for r in back.collect())


def test_toxicity(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(400):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        words = [f"w{rng.randint(0, 90)}{'abc'[rng.randint(0, 2)]}x" for _ in range(30)]
        words += ["scumbag"] * toxic + [rng.choice(["junky", "spammy"])] * poor
        rng.shuffle(words)
        words = [re.sub(r"\d", lambda m: "klmnopqrst"[int(m[0])], w) for w in words]
        docs.append((k, " ".join(words)))
        if k < 300:
            labels.append((k, int(not poor), None if k % 17 == 0 else int(toxic)))
    docs += [(400, None), (401, "")]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs_of(spark, docs), frame, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    assert [n for n, _ in chain] == ["low_quality", "toxic"] and len(chain[1][1].earlier) == 1
    found = {r.doc_id: r for r in toxicity.score(docs_of(spark, docs), chain).collect()}
    truth = {k: "scumbag" in (t or "") for k, t in docs}
    unseen = [k for k in truth if k >= 300]  # rows without a label
    assert sum(found[k].toxic == truth[k] for k in unseen) >= 0.97 * len(unseen)
    assert not found[400].toxic and 0 <= found[400].p_toxic <= 1
    none = toxicity.fit(docs_of(spark, docs), frame.limit(0), {"toxic": F.col("toxic")})
    assert none == [("toxic", None)]
    assert {(r.p_toxic, r.toxic) for r in toxicity.score(docs_of(spark, docs), none).collect()} == {(None, False)}
    assert toxicity.score(docs_of(spark, docs).limit(0), chain).count() == 0


def test_toxicity_held_out(spark):
    """On the given tables: fitted on three quarters of the labels, judged on the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    chain = toxicity.fit(docs, labels.where(~rest), {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    judged = toxicity.score(docs.join(labels.where(rest).select("doc_id"), "doc_id", "left_semi"), chain).select("doc_id", F.col("toxic").alias("said"))
    hit, all_, said = labels.join(judged, "doc_id").agg(F.count_if(F.expr("said AND toxic = 1")), F.count_if(F.expr("toxic = 1")), F.count_if("said")).first()
    assert hit >= 0.9 * all_ and hit >= 0.93 * said
