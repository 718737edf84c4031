"""Queries over flat layers: they neither exchange nor store anything, and odd texts match the SQL."""

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratum import storage
from stratum.operators import align, index, local, local_index, merge
from stratum.plans import catalog, formats
from stratum.sources import conllu, documents

from .compare import rows_match

ODD = [
    None, "", "  \n", "a", "_", "_ | a_b ² 7 x", " Ein  Satz. Noch\neiner!\x0b", "éaß_9 \U0001f648\U00010400|", "..a\r\n\r\nb", "x", "ä.", "$#\"\\/<>&' | ||   \x01 \x85", "A b. C d? E! f", "1 22 333 4.\n5 $ 6 # 7",
    "stream ],\" [ ] { } \"stream\":[ ]}}", "word " * 400, "中文。 ☃ ­ ٠١", "a\tb\nc\rd\x0ce",
]


def _written(d, texts, sources):
    rows = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["de", "en", "fr"] * 6, "source": sources * 6, "n_chars": [len(x or "") for x in texts]}
    pq.write_table(pa.table(rows, pa.schema({"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()})), d / "documents.parquet")
    return str(d)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return _written(tmp_path_factory.mktemp("odd"), ODD, ["web", 'b&"<', ""])


@pytest.fixture(scope="module")
def given(tmp_path_factory):
    """Without cells that are _ and blank fields, which documents leave out and the SQL doesn't."""
    return _written(tmp_path_factory.mktemp("given"), [x and " ".join(w for w in x.split(" ") if w != "_") for x in ODD], ["web", 'b&"<', "\\\n"])


NAMES = ["conllu_full", "conllu_parse", "dependency_xml", "rule_parser", "rule_trees", "morpho_xml", "index_stream", "patch_foundries", "index_json", "merge_foundry", "merge_twice"]


@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_exchanged(spark, name):
    """The finding was disk, which grew with the input: now no row of tokens leaves the task of its text."""
    path = storage.run_dir(spark)[7:]
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert (set(os.listdir(path)) if os.path.isdir(path) else set()) == before


@pytest.mark.parametrize("step", [1, 40, 1 << 18])
@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(spark, odd, given, name, step, monkeypatch):
    """Whatever texts share a slice."""
    each = local.each
    monkeypatch.setattr(local, "each", lambda *a, **k: each(*a, **{**k, "step": step}))
    if name != "conllu_parse":
        rows_match(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], odd if name in NAMES[:6] else given)
        return
    # a cell that is _ reads back as empty, which the SQL doesn't know: against the operators on rows
    texts = catalog._conllu_texts(spark, odd).select(F.col("text_id").alias("file"), F.col("conllu").alias("content"))
    assert sorted(map(repr, catalog.QUERIES[name](spark, odd).collect())) == sorted(map(repr, conllu.parse(texts).collect()))


CONLLU = [
    None, "", "1\tno\n",
    "# foundry = f\r\n# text_id =  C_D.1 \r\n# start_offsets = 0 0 5\r\n# end_offsets = 9 4 9\r\n1\tDies\t_\tA\tB\tC\t2\tx\t_\t_\r\n2\tist\t|\t_\t_\t_\t0\troot\t_\tm\textra\r\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\r\n\r\n"
    "# start_offsets = 10 10\n1\tlost\t_\t_\t_\t_\t_\t_\t_\t_\n# end_offsets = 12 12 x 7\n1\tkept\t_\t_\t_\t_\t_\t_\t_\t_\n2\tnone\t_\t_\t_\t_\t_\t_\t_\t_\n"
    "# foundry = g\n# text_id = C_D.2\n# start_offsets = 0 +1\n# end_offsets = 3 3\n1\ta\t_\t_\t_\t_\t_\t_\t_\t_\n00000000001\tb\t_\t_\t_\t_\t_\t_\t_\t_\n# text_id = C_D.1\n# start_offsets = 7 7\n# end_offsets = 9 9\n1\tb\t_\t_\t_\t_\t_\t_\t_\t_\n",
    "# start_offsets = 0 0\n# end_offsets = 1 1\n1\tnamed by none\t_\t_\t_\t_\t_\t_\t_\t_\n",
]


@pytest.mark.parametrize("foundry", [None, "own"])
def test_conllu_parses_alike(spark, foundry):
    """Broken files, several texts in one, comments that lack: as the parser of rows."""
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(CONLLU)], "file string, content string")
    want = conllu.parse(df, foundry, strict=False)
    got = local.parse_conllu(pa.array(CONLLU, pa.string()), foundry, strict=False).to_pylist()
    assert sorted(map(repr, got)) == sorted(repr(r.asDict()) for r in want.collect()) and len(got) == 6
    with pytest.raises(ValueError):
        local.parse_conllu(pa.array(CONLLU, pa.string()), foundry)


def test_readings_and_heads_of_any_layer(spark):
    """Cells with certainties, repeated and missing spans, and trees, against the operators on rows."""
    batch = pa.RecordBatch.from_pydict({"text_id": ["a", "b"], "text": ["Eins zwei. Drei", "x y"]})
    t = local.tokens(batch)
    cells = [("a|b", "U", "X|Y", None, "0.2|0.8"), ("a|a|b", None, None, "F", None), ("l", None, "X", None, "0.5"), (None, None, "X|Y", "F=1", "Offset=1|0.25|0.75"), ("_", "_", "_", "_", "word")]
    spans = [(0, 0, 4, 0), (0, 5, 9, 1), (0, 9, 10, 2), (1, 0, 1, 3), (1, 2, 3, 4), (0, 0, 4, 4), (0, 0, 4, 0), (1, 0, 2, 1)]
    x = np.array(spans)
    names = ("lemma", "upos", "xpos", "feats", "misc")
    morpho = local.Layer(x[:, 0], x[:, 1], x[:, 2], "f", x[:, 3], {k: pa.array(c, pa.string()) for k, c in zip(names, zip(*cells))})
    last = {s[:3]: s for s in spans}.values()
    rows = spark.createDataFrame([("ab"[i], "f", a, b, *cells[c]) for i, a, b, c in last], "text_id string, foundry string, from int, to int, " + ", ".join(f"{k} string" for k in names))
    spans_df = documents.spans(spark.createDataFrame(batch.to_pylist()))
    scanned = catalog._scanned(spans_df)
    dep = [("a", "d", 0, 4, "k", 5, 9), ("a", "d", 5, 9, "q", 0, 15), ("b", "d", 2, 3, "k", 0, 1)]
    relations = local.Relations(np.array([0, 0, 1]), np.array([0, 5, 2], np.int32), np.array([4, 9, 3], np.int32), "d", np.array([0, 1, 0]), pa.array(["k", "q"]), np.array([5, 0, 0], np.int32), np.array([9, 15, 1], np.int32))
    headed = align.heads(spans_df.drop("sent_idx"), spark.createDataFrame(dep, "text_id string, foundry string, from int, to int, deprel string, head_from int, head_to int"))
    one = align.with_morpho(scanned.join(headed.select("text_id", "tok_idx", "head", "deprel"), ["text_id", "tok_idx"]), rows)
    want = formats.conllu_texts(formats.conllu_rows(one), formats.offset_comments(scanned, catalog._sentences(spans_df)), "f")
    assert local.conllu(t, morpho, relations, "f").to_pylist() == [r.conllu for r in want.orderBy("text_id").collect()]
    xml = formats.morpho_xml(align.with_morpho(spans_df, rows))
    assert local.morpho_xml(t, morpho).to_pylist() == [r.asDict() for r in xml.orderBy("text_id").collect()]


def test_depths_of_shared_and_missing_nodes(spark):
    names, kids = ["r", "a", "b", "c", "r", "x", "y"], [["a", "b", "none"], ["c"], ["c", "a"], [], ["x"], ["y"], ["x"]]
    nodes = local.Nodes(np.array([0] * 4 + [1] * 3), np.zeros(7), np.zeros(7), names, names, [[(True, c) for c in k] for k in kids])
    nodes.children[5] = [(False, "t_1")]
    at, depth = local.tree_depths(nodes)
    df = spark.createDataFrame([("01"[nodes.text[i]], "f", names[i], [("node" if k else "morpho", c) for k, c in nodes.children[i]]) for i in range(7)], "text_id string, foundry string, node_id string, children array<struct<kind:string,id:string>>")
    want = sorted((r.text_id, r.node_id, r.depth) for r in align.tree_depths(df).collect())
    assert sorted(("01"[nodes.text[i]], names[i], k) for i, k in zip(at.tolist(), depth.tolist())) == want
    nodes.children[3] = [(True, "a")]
    with pytest.raises(RuntimeError):
        local.tree_depths(nodes)


def test_documents_merge_alike(spark):
    """Spans with attributes, counts, relations and other foundries, members behind the stream and odd white space: byte for byte as the
    merge of rows, which reads and sorts everything."""
    stream = [
        ["-:base/sentences$<i>2", "-:rule/sentences$<i>1", "-:tokens$<i>2", "<>:base/s:s$<b>64<i>0<i>9<i>1<b>2", "@:dereko/s:a:b$<b>17<s>2<i>1", "<>:rule/s:s$<b>64<i>0<i>9<i>1<b>2", "@:dereko/s:gone$<b>17<s>2<i>1", "_0$<i>0<i>4", "i:a", "<:rule/d:x$<b>32<i>1", "<:zz/d:x$<b>32<i>1", "aa/p:C", "rule/m:a:b", "rule/p:A", ">:zz/d:q$<b>32<i>1", "s:rule/p:"],
        ["_1$<i>5<i>9", 'i:],"', "base/p:_", "rule/p:A", "zz/l:\\#", 's:],"stream":[ "'],
    ]
    field = [{"@type": "field", "type": "type:string", "key": "textSigle", "value": "C/D/1"}, {"key": "k", "type": "type:keywords", "value": ["a"]}]
    data = {"text": "a ] [", "layerInfos": "dereko/s=spans rule/p=tokens zz/l=tokens", "foundries": "x", "name": "tokens", "stream": stream}
    first, second = {"@type": "corpus", "fields": field, "data": data}, {"fields": [{**field[0], "value": "C/D/2"}], "data": {**data, "more": ["]"]}, "last": [1]}
    docs = [json.dumps(first, ensure_ascii=False, separators=(",", ":")), json.dumps(second, indent=1), json.dumps({**first, "fields": [{**field[0], "value": "C/D/3"}]})]
    new = local_index.Source(local_index.FOUNDRY, "rule", np.arange(4), pa.array(["rule/p:NEW"]), np.zeros(4, np.int64))
    got = local_index.merge(pa.array(docs), [new], np.array([0, 2, 4, 6]), [{(4, "rule/p=tokens")}] * 3).to_pylist()
    df = spark.createDataFrame([(f"C-D-{i + 1}.json", d) for i, d in enumerate(docs)], "name string, json string")
    items = spark.createDataFrame([(f"C_D.{i}", k) for i in (1, 2) for k in (0, 1)], "text_id string, tok_idx int").withColumn("items", F.array(index.item("foundry", F.lit("rule"), F.lit("000000"), F.lit("rule/p:NEW"))))
    layer = spark.createDataFrame([(f"C_D.{i}", 4, "rule/p=tokens") for i in (1, 2)], "text_id string, rank int, layer string")
    want = [r.json for r in merge.merge(df, annotations=items, layers=layer).orderBy("name").collect()]
    assert got == want and got[2] == docs[2] and "gone" not in got[0]
    with pytest.raises(ValueError):
        local_index.merge(pa.array(docs), [new], np.array([0, 2, 4, 7]), [set()] * 3)


def test_streams_of_any_layer(spark):
    """Several foundries on a token, repeated spans, more than one relation into a token, roots."""
    batch = pa.RecordBatch.from_pydict({"text_id": ["a", "b"], "text": ["Eins zwei. Drei", "x #"]})
    t = local.tokens(batch)
    cells = [("a|b", "U", "X|Y", "K=v|bad", "0.2|0.8"), ("l", None, "Z#", "F=1|E=2", None)]
    names = ("lemma", "upos", "xpos", "feats", "misc")
    spans = [(0, 5, 9, 1), (0, 0, 4, 0), (0, 0, 4, 1), (1, 2, 3, 1)]
    x = np.array(spans)
    layer = lambda f: local.Layer(x[:, 0], x[:, 1], x[:, 2], f, x[:, 3], {k: pa.array(c, pa.string()) for k, c in zip(names, zip(*cells))})
    dep = [("a", "d", 0, 4, "k", 5, 9), ("a", "d", 9, 10, "j", 5, 9), ("a", "d", 5, 9, "q", 0, 15), ("b", "d", 2, 3, "k", 0, 1)]
    r = local.Relations(np.array([0, 0, 0, 1]), np.array([0, 9, 5, 2], np.int32), np.array([4, 10, 9, 3], np.int32), "d", np.array([0, 1, 2, 0]), pa.array(["k", "j", "q"]), np.array([5, 5, 0, 0], np.int32), np.array([9, 9, 15, 1], np.int32))
    s, _ = local.sentences(t)
    foundries = ["tree_tagger", "base", "alpha"]
    counts = [local_index.count(t, "base/sentences", "1", s.text), local_index.count(t, "tokens", "2", t.text)]
    got = local_index.streams(len(t.text), [*counts, local_index.spans(t, s, "base/s:s", 2), *local_index.own(t), *[y for f in foundries for y in local_index.readings(t, layer(f))], *local_index.edges(t, r)]).joined(" ").to_pylist()
    df = documents.spans(spark.createDataFrame(batch.to_pylist()))
    sents = catalog._sentences(df)
    ranges = align.token_range(sents.select("text_id", "from", "to"), df).withColumns({"layer": F.lit("base/s:s"), "depth": F.lit(2)})
    morpho = spark.createDataFrame([("ab"[i], f, a, b, *cells[c]) for f in foundries for i, a, b, c in spans], "text_id string, foundry string, from int, to int, " + ", ".join(f"{k} string" for k in names))
    rows = index.token_annotations(df.drop("sent_idx"), sents, ranges, morpho, align.edges(df.drop("sent_idx"), spark.createDataFrame(dep, "text_id string, foundry string, from int, to int, deprel string, head_from int, head_to int")), "d")
    assert got == [" ".join(r.stream) for r in index.streams(rows).orderBy("text_id", "tok_idx").collect()]
