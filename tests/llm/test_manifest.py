"""The manifest, token files and spelling variants: each against a plain version, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from checks.compare import differences, duck_connection
from llm.helpers import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import merkle_manifest, orc_tokens, pivotal_grams, registry, twins

SF_DIR = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ODD = [None, "", " ", "a", "a", "\n", "tie Tie TIE", "tie Tie TIE", "ünï cödé 日本 🤣", "Long " * 20_000]
CLASH = ["hash", "grp", "position", "height", "leaf", "root", "file", "start", "ids", "word", "n", "_own", "_key"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, null keys and languages, and columns that clash with the operators'."""
    docs = documents(spark, ODD).union(documents(spark, ["again"] * 3, 100)).union(documents(spark, ["again"], 100))
    nulls = documents(spark, ["No key", "No key", None])
    nulls = nulls.withColumns({c: F.lit(None).cast(t) for c, t in [("doc_id", "long"), ("lang", "string")]})
    return docs.union(nulls).withColumns({name: F.lit("clash") for name in CLASH})


# --- manifest ------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [text if name == "text" else row[name] for name in FIELDS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and for each node the siblings on its way, left and right."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, places):
            first = at // 8 * 8
            path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        places = [at // 8 for at in places]
    return nodes[0], paths


def plain_manifest(rows, change=lambda row: row["text"]):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], plain_leaf(r, r["text"])))
        trees[name] = plain_tree([plain_leaf(r, r["text"]) for r in groups[name]])
    root, above = plain_tree([trees[name][0] for name in names])
    out = []
    for name, over in zip(names, above):
        for row, path in zip(groups[name], trees[name][1]):
            node, path = plain_leaf(row, change(row)), path + over
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path))
            out.append((row["doc_id"], plain_leaf(row, row["text"]), trees[name][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def tampered(row):
    hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"]) if hit and row["text"] else row["text"]


def manifest_rows(docs):
    found = merkle_manifest.manifest(docs, FIELDS)
    siblings = F.col("siblings")
    return sorted(
        map(
            tuple,
            found.select(
                "doc_id",
                "leaf",
                "subroot",
                "root",
                merkle_manifest.siblings_digest(siblings),
                merkle_manifest.fold(F.col("leaf"), siblings),
                merkle_manifest.verified(F.col("leaf"), siblings, F.col("root")),
            ).collect(),
        ),
        key=repr,
    )


def test_manifest_query(spark):
    got = sorted(map(tuple, registry.op11_merkle_manifest(spark, SF_DIR).collect()), key=repr)
    rows = [r.asDict() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert got == plain_manifest(rows, tampered)
    assert {r[-1] for r in got} == {True, False}
    changed = {r["doc_id"] for r in rows if tampered(r) != r["text"]}
    assert {r[0] for r in got if not r[-1]} == changed


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_spelling_variants"])
def test_sql_twins(spark, name):
    found = registry.queries()[name](spark, SF_DIR)
    assert differences(found, duck_connection(SF_DIR), registry.oracle_sql()[name]) == []


def test_checksum_in_sql():
    import duckdb

    for text in ("0", "123456789", "Zoë"):
        sql = f"SELECT {twins.crc32(twins.utf8_bytes(chr(39) + text + chr(39)))}"
        assert duckdb.sql(sql).fetchall()[0][0] == zlib.crc32(text.encode())


# One more than a power of eight leaves a run of one node on each level.
@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1, 64], [65, 7], [512, 1], [513], [1537, 3], [4097]])
def test_manifest_of_any_size(spark, sizes):
    rows = [(i, f"t{i}", f"g{g}", "s", g) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert manifest_rows(docs) == plain_manifest([dict(zip(names, r)) for r in rows])


def test_manifest_of_many_groups_and_repeats(spark):
    rows = [(i % 7, "same" if i % 3 else f"t{i}", f"g{i % 11:02}" if i % 11 else None, "s", 1) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert manifest_rows(docs.repartition(5)) == plain_manifest([dict(zip(names, r)) for r in rows])


def test_manifest_of_odd_rows(spark, odd):
    rows = [r.asDict() for r in odd.collect()]
    assert manifest_rows(odd) == plain_manifest(rows)
    assert manifest_rows(odd.limit(0)) == []
    with pytest.raises(ValueError, match="clash"):
        merkle_manifest.manifest(odd, FIELDS, carried={"leaf": F.lit(1)})


def test_manifest_tells_a_null_from_a_dash(spark):
    docs = documents(spark, [None, "-", "", "1:-"]).withColumn("doc_id", F.lit(1).cast("long"))
    assert len({r[1] for r in manifest_rows(docs.withColumn("n_chars", F.lit(1)))}) == 4


# --- token files -----------------------------------------------------------------------

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_digests(rows):
    """Digests by the tokenizer as it is, of (doc_id, text) in order."""
    tokenizer, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_units_have_the_ids_of_whole_texts():
    assert orc_tokens.cut_at_spaces(TOKENIZER)
    assert not orc_tokens.cut_at_spaces(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer, encode, draw = Tokenizer.from_file(TOKENIZER), orc_tokens.text_encoder(TOKENIZER), random.Random(5)
    marks = [0x300, 0x301, 0x308, 0x30C, 0x345, 0x130, 0x3A3, 0x3C2, 0x212B, 0x1E9E, 0x1100, 0x1161, 0x2028, 0x3000, 0x1F600]
    pool = [*map(chr, [*range(0x180), *marks]), "<|endoftext|>", "<|STARTOFTEXT|>", "'LL", "don't", "Word.", "J̌", " ", "\n"]
    texts = ["", " ", "a " * 3000, "x" * 5000, "'s", "Ünder.Über,,x", "end.̈"]
    texts += ["".join(draw.choices(pool, k=draw.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(draw.choices("abcXYZéÀ  .,!'19", k=40)) for _ in range(1000)]
    got = encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a  b\n\nc", "<|endoftext|> x", ""]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in orc_tokens.text_encoder(path)([t.encode() for t in texts])] == want


def test_checksums_of_parts_come_to_that_of_the_whole():
    draw = random.Random(1)
    for sizes in ([0], [5], [3, 0, 4], [1000, 1, 70_000, 16]):
        parts = [draw.randbytes(n) for n in sizes]
        after, crc = sum(sizes), 0
        for part in parts:
            after -= len(part)
            crc ^= orc_tokens.moved(zlib.crc32(part), after)
        assert crc == zlib.crc32(b"".join(parts))


def test_token_files_query(spark):
    got = sorted(map(tuple, registry.op12_token_files(spark, SF_DIR).collect()))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert got == plain_digests(sorted(map(tuple, docs)))


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    got = sorted(map(tuple, orc_tokens.round_trip(odd, TOKENIZER, f"{tmp_path}/odd").collect()), key=lambda r: r[1])
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert [r[0] is None for r in got] == sorted([r[0] is None for r in rows], reverse=True)
    keys = [r[0] for r in got if r[0] is not None]
    assert keys == sorted(keys) and len(got) == len(rows)
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))  # no gaps
    want = collections.Counter((key, n, crc) for key, _, n, crc in plain_digests(rows))
    assert collections.Counter((key, n, crc) for key, _, n, crc in got) == want
    assert max(r[2] for r in got) > 2 * orc_tokens.PIECE
    assert orc_tokens.round_trip(odd.limit(0), TOKENIZER, f"{tmp_path}/none").count() == 0


def test_token_files_are_sorted_indexed_and_pruned(spark, tmp_path):
    import glob

    from pyarrow import orc

    draw = random.Random(4)
    texts = [" ".join(str(draw.randrange(10**6)) for _ in range(10)) for _ in range(12_000)]
    docs = documents(spark, texts)
    folder = f"{tmp_path}/files"
    orc_tokens.write_files(orc_tokens.encode_pieces(docs, TOKENIZER), folder, stripe_bytes=1 << 16, index_rows=1000)
    files = sorted(glob.glob(f"{folder}/*.orc"))
    keys = [orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist() for f in files]
    assert sum(keys, []) == list(range(12_000))
    assert max(orc.ORCFile(f).nstripes for f in files) > 1
    with open(files[0], "rb") as file:
        assert b"ORC" in file.read(3)
    found = orc_tokens.lookup(spark, folder, [7, 11_999])
    assert "PushedFilters: [In(doc_id, [" in found._jdf.queryExecution().toString()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for row in found.collect():
        assert row.ids == [*tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids, 1]
    assert found.count() == 2


def test_a_lost_piece_is_told(spark):
    docs = documents(spark, ["word " * 10_000])
    pieces = orc_tokens.encode_pieces(docs, TOKENIZER)
    assert pieces.count() == 3
    with pytest.raises(Exception, match="missing in the files"):
        orc_tokens.digests(pieces.where("piece_start != 4096")).collect()


# --- spelling variants -----------------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows, one_in, shortest=5, least=3):
    found = collections.Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def plain_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out, form = [], {}
    near = {w: [o for o in counts if plain_near(w, o)] for w in counts}
    for word, n in counts.items():
        best = min(near[word], key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[word] = best
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        out.append((word, n, len(near[word]), form.get(word), counts.get(form.get(word)), root))
    return sorted(out)


def variant_rows(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_variants_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = variant_rows(registry.op13_spelling_variants(spark, SF_DIR))
    assert got == plain_variants(plain_words(docs, 97))
    assert any(r[3] and r[3] != r[5] for r in got)  # some chain has two steps


@pytest.mark.parametrize("alphabet, lengths", [("ab", (4, 9)), ("abcé", (4, 7)), ("ÿz", (5, 11))])
def test_no_near_pair_is_lost(spark, alphabet, lengths):
    draw = random.Random(alphabet)
    words = {"".join(draw.choices(alphabet, k=draw.randint(*lengths))) for _ in range(500)}
    counts = {w: draw.choice([3, 4, 7, 14, 30, 10**9]) for w in words}
    assert variant_rows(pivotal_grams.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == (
        plain_variants(counts)
    )


def test_pivots_are_the_rarest_disjoint_bigrams(spark):
    draw = random.Random(2)
    words = {"".join(draw.choices("abcdeé", k=draw.randint(4, 12))) for _ in range(800)}
    weight = collections.Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    ranks = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in weight.items()), start=1)}
    rows = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    for r in pivotal_grams.pivoted(rows).collect():
        grams = sorted((ranks[r.word[i : i + 2]], i) for i in range(len(r.word) - 1))
        prefix = [(rank, i) for rank, i in grams if rank <= grams[2][0]]
        assert (r["last"], sorted(r.prefix)) == (grams[2][0], sorted(i for _, i in prefix))
        cost = {i: weight[r.word[i : i + 2]] for _, i in prefix}
        assert r.p2 - r.p1 >= 2
        assert cost[r.p1] + cost[r.p2] == min(cost[i] + cost[j] for i in cost for j in cost if j - i >= 2)


def test_chains_lead_to_their_ends(spark):
    counts = {"a" * k + "b" * (70 - k): 3 << min(k, 40) for k in range(5, 42)}
    got = variant_rows(pivotal_grams.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain_variants(counts)
    assert len({r[5] for r in got}) < 4


def test_variants_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for one_in in (0, 2, 97):
        got = pivotal_grams.spelling_variants(odd, one_in, shortest=4, least=1)
        assert variant_rows(got) == plain_variants(plain_words(rows, one_in, 4, 1))
    assert pivotal_grams.spelling_variants(odd.limit(0)).count() == 0
    long = documents(spark, ["x" * 100_000 + "É" * 70 + " " + "wörd×÷ " * 3, "y" * 64 + " " + "Y" * 65] * 3)
    rows = [(r.doc_id, r.text) for r in long.collect()]
    assert {r.word: r.n for r in pivotal_grams.word_counts(long, 3, 1, 1).collect()} == plain_words(rows, 3, 1, 1)


def test_variants_broadcast_the_bigrams_alone(spark, monkeypatch):
    draw = random.Random(3)
    words = {"".join(draw.choices("abcé", k=draw.randint(5, 8))) for _ in range(200)}
    counts = {w: draw.choice([3, 7, 30]) for w in words}
    plans = []

    def seen(df, *more, write=pivotal_grams.durable):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *more)

    monkeypatch.setattr(pivotal_grams, "durable", seen)
    found = pivotal_grams.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    seen(found)
    joins = [re.findall(r"\w+Join\b", plan) for plan in plans]
    assert sorted({j for some in joins for j in some}) == ["BroadcastHashJoin", "SortMergeJoin"]
    assert [some.count("BroadcastHashJoin") for some in joins if "BroadcastHashJoin" in some] == [1]
    assert variant_rows(found) == plain_variants(counts)


def test_variants_refuse_what_they_cannot_do(spark):
    counts = spark.createDataFrame([("abc", 3), ("abcd", 3)], "word string, n long")
    with pytest.raises(ValueError, match="times"):
        pivotal_grams.variants(counts, 1)
    with pytest.raises(Exception, match="fewer than four letters"):
        pivotal_grams.variants(counts).collect()
