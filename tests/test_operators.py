import json
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from stratum import storage
from stratum.functions import text as tx
from stratum.operators import align, annotate, counters, index, merge, meta, rank
from stratum.plans import catalog, formats, outputs
from stratum.sources import archive, conllu, documents, headers, layers
from stratum.streaming.completion import complete_texts


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, iso", [("1932.03.03", "1932-03-03"), ("Donnerstag, 04.10.2018", "2018-10-04"), ("2020.05", "2020-05"), ("2016", "2016"), ("1920.05.01-1923.05.02", "1920-05-01"), ("2018-10-04", "2018-10-04"), ("no date", None)])
def test_dates(spark, raw, iso):
    assert one(spark, tx.normalise_date(F.col("d")), d=raw) == iso


def test_composed_date(spark):
    none = F.lit(None).cast("string")
    assert one(spark, tx.compose_date(F.lit("1960"), F.lit("7"), none, none)) == "1960-07"
    assert one(spark, tx.compose_date(F.lit("1960"), none, F.lit("3"), none)) == "1960"


def test_month_order(spark):
    ids = [f"Z24_{m}.00001" for m in ("OKT", "JAN", "DEZ", "SEP", "MAR")]
    df = spark.createDataFrame([(i,) for i in ids], "id string").orderBy(tx.order_key(F.col("id")))
    assert [r.id[4:7] for r in df.collect()] == ["JAN", "MAR", "SEP", "OKT", "DEZ"]


def test_escapes(spark):
    assert one(spark, tx.escape_value(F.col("a")), a="a#b$c") == "a\\#b\\$c"
    assert one(spark, tx.escape_attribute(F.col("a")), a="#$:<>") == "%23%24%3A%3C%3E"
    value = 'a"b\\c\n\t\x01é🙈'
    assert json.loads('"' + one(spark, tx.escape_json(F.col("a")), a=value) + '"') == value


def test_readings(spark):
    assert one(spark, F.array_join(rank.payloads(F.lit("tt"), F.col("x"), F.col("m")), " "), x="ADV|KON", m="0.784759|0.215241") == "tt/p:ADV$<b>129<b>200 tt/p:KON$<b>129<b>55"
    assert one(spark, rank.sorted_lemma(F.col("l"), F.col("x"), F.col("m")), l="aus|aus", x="APPR|PTKVZ", m="0.1|0.9") == "aus"
    assert one(spark, rank.sorted_pos(F.col("x"), F.col("m")), x="A|B|C", m="0.1|0.9") == "A|B|C"


def scan(starts, ends):
    """The scan, step by step."""
    x, out = 0, []
    for f in starts:
        border = x >= len(ends) or f >= ends[x]
        x += border
        out.append((x, border))
    return out


def test_sentence_scan(spark):
    rnd, tokens, ends, want = random.Random(7), [], [], {}
    for t in range(120):
        starts = sorted(rnd.sample(range(60), rnd.randint(1, 15)))
        es = sorted(rnd.sample(range(1, 60), rnd.randint(0, 8)))
        tokens += [(str(t), i, f, f + 1) for i, f in enumerate(starts)]
        ends += [(str(t), e) for e in es]
        want |= {(str(t), i): w for i, w in enumerate(scan(starts, es))}
    rows = align.sentence_scan(spark.createDataFrame(tokens, "text_id string, tok_idx int, from int, to int"), spark.createDataFrame(ends, "text_id string, to int")).collect()
    assert {(r.text_id, r.tok_idx): (r.sent, r.boundary) for r in rows} == want


def test_token_range_falls_back(spark):
    tokens = spark.createDataFrame([("a", 0, 2, 4), ("a", 1, 5, 7)], "text_id string, tok_idx int, from int, to int")
    spans = spark.createDataFrame([("a", 0, 4, 5), ("a", 1, 0, 7)], "text_id string, span_id int, from int, to int")
    assert {r.span_id: (r.token_from, r.token_to) for r in align.token_range(spans, tokens).collect()} == {0: (0, 2), 1: (0, 2)}


def test_inheritance_ignores_blanks(spark):
    t = spark.createDataFrame([("x", "d", "c", " ")], "text_id string, doc string, corpus string, pubPlace string")
    d, c = spark.createDataFrame([("d", "Doc Place")], "doc string, pubPlace string"), spark.createDataFrame([("c", "Corpus Place")], "corpus string, pubPlace string")
    assert meta.inherit(t, d, c, ["pubPlace"]).first().pubPlace == "Doc Place"


def test_metadata_without_match_gives_no_column(spark):
    assert one(spark, meta.extract(F.col("h"), ["<a>(.*?)</a>", "<b>(.*?)</b>", "<c>(.*?)</c>"]), h="<a>1</a><c>3</c>") == ["1", "3"]


def test_xeno(spark):
    assert one(spark, meta.xeno_key(F.lit("P"), F.lit("rcpnt"), "doc")) == "P.docRcpnt"
    assert one(spark, meta.xeno_key(F.lit("P"), F.lit("my_text_id"), "text")) == "P.myTextID"
    assert one(spark, meta.xeno_date(F.lit("20200500"))) == "2020-05"


def test_links(spark):
    rows = spark.createDataFrame([("W24", None, "ID: 216199263", None), ("W24", "X URL:https://de.example.org/w: Wikipedia, 2019", "ID: 1", None), ("Q", None, None, None)], "corpus string, reference string, note string, title string")
    names = spark.createDataFrame([("w", "WELT")], "code string, name string")
    assert [r.link for r in meta.external_link(rows, names, archive=("https://n.example.org/", "N")).orderBy(F.col("corpus").desc(), "note").collect()] == ["https://de.example.org/w", "https://n.example.org/WELT__216199263", None]


DATA = '<?xml version="1.0"?><raw_text docid="C_D.1"><text> Ein  Text </text></raw_text>'
TOKENS = '<layer docid="C_D.1"><!-- bad -- comment --><spanList><span id="t_0" from="1" to="4"/><span id="t_1" from="6" to="10"/><span from="x" to="1"/></spanList></layer>'
MORPHO = '<layer docid="C_D.1"><spanList><span from="1" to="4"><fs type="lex"><f name="lex"><fs><f name="lemma">ein</f><f name="pos">ART</f><f name="certainty">0.9</f></fs></f></fs><fs type="lex"><f name="lex"><fs><f name="lemma">UNKNOWN</f><f name="pos">PIS</f><f name="certainty">0.1</f></fs></f></fs></span></spanList></layer>'
STRUCT = '<layer docid="C_D.1"><spanList><span from="0" to="11" l="2"><fs><f name="name">s</f><f name="attr"><fs><f name="id">x</f></fs></f></fs></span></spanList></layer>'
DEP = '<layer docid="C_D.1"><spanList><span from="1" to="4"><rel label="nk"><span from="6" to="10"/></rel></span></spanList></layer>'
CONST = '<layer docid="C_D.1"><spanList><span id="n0" from="0" to="11"><fs type="node"><f name="const">NP</f></fs><rel label="dominates" target="n1"/><rel label="dominates" uri="morpho.xml#m1"/></span><span id="n1" from="1" to="4"><fs type="node"><f name="const">D</f></fs><rel label="dominates" uri="morpho.xml#m0"/></span></spanList></layer>'


@pytest.fixture(scope="module")
def zipped(tmp_path_factory):
    d = tmp_path_factory.mktemp("zip")
    with zipfile.ZipFile(d / "c.zip", "w") as z:
        for name, xml in (("data.xml", DATA), ("base/tokens.xml", TOKENS), ("struct/structure.xml", STRUCT)):
            z.writestr(f"C/D/1/{name}", xml)
    with zipfile.ZipFile(d / "c.tt.zip", "w") as z:
        for name, xml in (("morpho.xml", MORPHO), ("dependency.xml", DEP), ("constituency.xml", CONST)):
            z.writestr(f"C/D/1/tt/{name}", xml)
    return d


def test_zip_layers(spark, zipped):
    archive.register(spark)
    rows = spark.read.format("layer_zip").load(str(zipped / "c.tt.zip"))  # brings c.zip along
    layer = lambda n: rows.filter(F.col("layer") == n)
    assert layers.data(layer("data")).first() == ("C_D.1", "C_D.1", " Ein  Text ")
    assert [tuple(r) for r in layers.tokens(layer("tokens")).orderBy("tok_idx").collect()] == [("C_D.1", 0, 1, 4), ("C_D.1", 1, 6, 10)]
    m = layers.morpho(layer("morpho")).first()
    assert (m.foundry, m.lemma, m.xpos, m.misc, m.feats) == ("tt", "ein|--", "ART|PIS", "0.9|0.1", None)
    s = layers.structure(layer("structure")).first()
    assert (s.name, s.depth, s.attributes) == ("s", 2, {"id": "x"})
    d = layers.dependency(layer("dependency")).first()
    assert (d.deprel, d.head_from, d.head_to) == ("nk", 6, 10)
    words = spark.createDataFrame([("C_D.1", "m0", "Ein"), ("C_D.1", "m1", "(Text)")], "text_id string, id string, surface string")
    assert annotate.brackets(layers.constituency(layer("constituency")), words).first().brackets == "(NP (D Ein) -LRB-Text-RRB-)"


def test_symbol_stands_for_features(spark):
    xml = '<layer><spanList><span from="0" to="2"><fs type="lex"><f name="lex"><fs><f name="type"><symbol value=" num "/></f></fs></f></fs></span><span from="3" to="4"><fs type="lex"><f name="lex"><fs><f name="type"><symbol value="x"/></f><f name="msd">a=b</f></fs></f></fs></span></spanList></layer>'
    m = layers.morpho(spark.createDataFrame([("a", "f", xml)], "text_id string, foundry string, xml string")).orderBy("from").collect()
    assert [r.feats for r in m] == ["num", "a=b"]


def test_attribute_selection(spark):
    s = layers.structure(spark.createDataFrame([("a", "f", STRUCT.replace("</f></fs></f>", '</f><f name="n"/></fs></f>'))], "text_id string, foundry string, xml string"))
    assert [r.line for r in layers.attributes(s, "s/(id|x)").collect()] == ["# s/id = x"] and layers.attributes(s, "id").count() == 0


def test_tree_spans(spark):
    nodes = layers.constituency(spark.createDataFrame([("a", "f", CONST)], "text_id string, foundry string, xml string"))
    got = sorted((r.layer, r["from"], r.to, r.depth) for r in layers.constituency_spans(nodes).collect())
    assert got == [("f/c:D", 1, 4, 1), ("f/c:NP", 0, 11, 0)] and layers.constituency_spans(nodes.limit(0)).count() == 0


def test_overlapping_sentences_share_no_token(spark):
    tokens = spark.createDataFrame([("a", i, 2 * i, 2 * i + 1) for i in range(6)], "text_id string, tok_idx int, from int, to int")
    sents = spark.createDataFrame([("a", 0, 0, 6), ("a", 1, 2, 9), ("a", 2, 20, 30)], "text_id string, sent_idx int, from int, to int")
    assert [tuple(r) for r in align.contained(sents, tokens).orderBy("sent_idx").collect()] == [("a", 0, 0, 2), ("a", 1, 3, 4)]


def test_strict_sentence_counter(spark):
    """A token that starts where a sentence ends still belongs to it; there is no sentence after the last; a relation past the text's end is dropped."""
    tokens = spark.createDataFrame([("a", 0, 0, 2, "0", "r"), ("a", 1, 5, 7, "1", "x"), ("a", 2, 9, 10, "2", "y"), ("a", 3, 30, 31, "9", "z"), ("a", 4, 33, 34, "_", "_")], "text_id string, tok_idx int, from int, to int, head string, deprel string")
    sents = spark.createDataFrame([("a", 0, 0, 5), ("a", 1, 6, 12)], "text_id string, sent_idx int, from int, to int")
    rows = [tuple(r)[1:] for r in align.relation_spans(tokens, sents).orderBy("tok_idx").collect()]
    assert rows == [(0, 0, 2, 0, 1, "r", 0, 5), (1, 5, 7, 0, 2, "x", 0, 2), (2, 9, 10, 1, 1, "y", 30, 31)]


def test_splice_keeps_all_else():
    text = ' {"a" : [1, {"fields":2}], "fields":[ {"key":"title","value":"x"} ,{"key":"dmozDomain"},{"key":"textClass"}, 7 ],\n"data":{"stream":[["s:\\"]"]], "odd":"\\u00e9", "layerInfos":"x"} , "z":null}'
    text = text.replace(", 7 ]", " ]")
    new = merge.splice(text, [("textClass", '{"key":"textClass","value":["y"]}', "replace"), ("title", "never", "append"), ("award", '{"key":"award"}', "append")], {"stream": "[[]]", "layerInfos": '"n"', "none": "1"})
    assert new == ' {"a" : [1, {"fields":2}], "fields":[{"key":"title","value":"x"},{"key":"textClass","value":["y"]},{"key":"award"}],\n"data":{"stream":[[]], "odd":"\\u00e9", "layerInfos":"n"} , "z":null}'
    assert merge.splice(text, [], {}) == text and merge.splice('{"fields":[]}', [("k", "{}", "replace")], {}) == '{"fields":[{}]}'


def test_merge_leaves_others_alone(spark):
    docs = spark.createDataFrame([("C-D-1.json.gz", '{ "fields" : [{"key":"textSigle","type":"type:string","value":"C/D/1"}], "data":{"text":"t","layerInfos":"tt/p=tokens","foundries":"tt","stream":[["_0$<i>0<i>1","tt/p:A","s:t"]]}}'), ("C-D-2.json.gz", "{ }")], "name string, json string")
    new = spark.createDataFrame([("C_D.1", 0), ("X_Y.1", 0)], "text_id string, tok_idx int").withColumn("items", F.array(index.item("foundry", F.lit("tt"), F.lit("0"), F.lit("tt/p:B"))))
    one = spark.createDataFrame([("C_D.1", 4, "tt/p=tokens")], "text_id string, rank int, layer string")
    got = {r.name: r.json for r in merge.merge(docs, annotations=new, layers=one).collect()}
    before = {r.name: r.json for r in docs.collect()}
    assert got["C-D-2.json.gz"] == "{ }" and got["C-D-1.json.gz"] == before["C-D-1.json.gz"].replace("tt/p:A", "tt/p:B").replace('"foundries":"tt"', '"foundries":"treetagger treetagger/morpho"')
    assert [r.text_id for r in merge.unmatched(docs, new).collect()] == ["X_Y.1"] and merge.merge(docs) is docs
    for bad in ((["a", "b"], "c", 1), (["a"], "c", 0), (["a"], "a", 1)):
        with pytest.raises(ValueError):
            merge.checked(*bad)


def test_output_names(spark, tmp_path):
    name = outputs.default_name
    assert name(["/x/wdf.tt.zip", "/x/wdf.zip"], "index", "/o") == "/o/wdf.index.tar" and name([], "index", output="a") == "a.tar" and name([], "index", "/o", archive="/x/wdf.index.tar") == "/o/wdf.updated.index.tar"
    assert name(["/x/wdf.zip"], "zip", "/o", foundry="tt") == "/o/wdf.tt.zip" and name(["/x/a.conllu"], "zip") == "/x/a.zip" and name(["/x/a.conllu"], "zip", "/o") == "/o/a.zip"
    lines = spark.createDataFrame([("a\nb",), ("c",)], "line string").coalesce(1)
    outputs.write_text(lines, f"{tmp_path}/t.gz")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t.gz/*.gz").collect()) == ["a", "b", "c"]
    with pytest.raises(Exception):
        outputs.write_text(lines, f"{tmp_path}/t.gz")
    outputs.write_text(lines, f"{tmp_path}/t.gz", overwrite=True)


def test_one_archive_of_many_tasks(spark, tmp_path):
    """Entries of all tasks in one archive, readable by others; what is there isn't written over unasked."""
    archive.register(spark)
    rows = spark.createDataFrame([(f"C/D/{i}/data.xml", f"<raw_text><text>{i} {'x' * i}</text></raw_text>".encode()) for i in range(40)], "path string, content binary").repartition(5)
    out = str(tmp_path / "one.zip")
    rows.write.format("layer_zip").mode("append").save(out)
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and len(z.namelist()) == 40 and z.infolist()[0].external_attr >> 16 == 0o644
    back = spark.read.format("layer_zip").load(out)
    assert {r.path: r.xml.encode() for r in back.collect()} == {r.path: bytes(r.content) for r in rows.collect()}
    assert back.filter("layer = 'data' AND text_id = 'C_D.3'").count() == 1 and back.filter("text_id = 'C_D.3'").filter("text_id = 'C_D.4'").count() == 0
    with pytest.raises(Exception):
        rows.write.format("layer_zip").mode("append").save(out)
    rows.limit(3).write.format("layer_zip").mode("append").option("mode", "overwrite").save(out)
    assert spark.read.format("layer_zip").load(out).count() == 3
    entries = archive.compress_entries(spark.createDataFrame([(f"C_D.{i}", f'{{"i":{i}}}') for i in range(30)], "text_id string, json string")).withColumn("mtime", F.lit(1_000_000).cast("long")).repartition(4)
    entries.write.format("index_tar").mode("append").save(str(tmp_path / "one.tar"))
    read = spark.read.format("index_tar").load(str(tmp_path / "one.tar"))
    assert {r.name: (bytes(r.content), r.mtime) for r in read.collect()} == {r.name: (bytes(r.content), 1_000_000) for r in entries.collect()}
    expanded = archive.expand_entries(read)
    assert {r.name: r.json for r in expanded.collect()}["C-D-7.json.gz"] == '{"i":7}'
    new = archive.repack_entries(expanded.filter("name = 'C-D-7.json.gz'").withColumn("json", F.lit("{}")))
    merged = {r.name: r for r in archive.merge_tar(read, new).collect()}
    assert merged["C-D-8.json.gz"].mtime == 1_000_000 and merged["C-D-7.json.gz"].content != {r.name: r.content for r in read.collect()}["C-D-7.json.gz"]
    assert [r.name for r in archive.unmatched_entries(read, spark.createDataFrame([("C-D-99.json.gz",)], "name string")).collect()] == ["C-D-99.json.gz"]
    with pytest.raises(Exception, match="lz4"):
        archive.compress_entries(spark.createDataFrame([("C_D.1", "{}")], "text_id string, json string"), codec="lz4").collect()


def test_input_planning_by_name(zipped, tmp_path):
    assert archive.excluded("/x/a[1].zip", "a[1].*") and not archive.excluded("/x/a1.zip", "a[1].*") and archive.excluded("b.zip", "a*, b.zi?")
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("123")
    assert [os.path.basename(p) for p in archive.largest_first([f"{tmp_path}/a", f"{tmp_path}/b", "none"])] == ["b", "a", "none"]


def test_texts_of_several_archives(spark):
    e = spark.createDataFrame([("b.zip", "t1", "base", "data"), ("a.zip", "t1", "base", "data"), ("a.tt.zip", "t1", "tt", "morpho"), ("a.tt.zip", "t2", "tt", "morpho")], "archive string, text_id string, foundry string, layer string")
    assert sorted(tuple(r) for r in archive.texts_with_data(e).select("archive", "text_id", "layer").collect()) == [("a.tt.zip", "t1", "morpho"), ("a.zip", "t1", "data")]


def test_long_lists_are_kept_whole(spark):
    """Topics, extra fields' names, link sources and fields beyond the lengths that once were cut."""
    assert len(one(spark, meta.topics(F.col("t")), t=".".join(["topic"] + [f"p{i}" for i in range(300)]))) == 300
    assert one(spark, meta.xeno_key(F.lit(None).cast("string"), F.col("n"), "doc"), n="a_" + "b" * 3000) == "docAB" + "b" * 2999
    names = spark.createDataFrame([(f"c{i}", f"N{i}") for i in range(1500)] + [("w", "WELT")], "code string, name string")
    row = spark.createDataFrame([("W24", None, "ID: 7", None)], "corpus string, reference string, note string, title string")
    assert meta.external_link(row, names, archive=("http://a/", "A")).first().link == "http://a/WELT__7"
    ids = spark.createDataFrame([("A_B.9999999999",), ("A_B.3000000000",), ("A_B.x",)], "id string").orderBy(tx.order_key(F.col("id")))
    assert [r.id for r in ids.collect()] == ["A_B.3000000000", "A_B.9999999999", "A_B.x"]


def test_morpho_xml_reads_back(spark):
    rows = spark.createDataFrame([("a", 0, 0, 3, "x&y", "ART|PIS", "0.9|0.1", "N")], "text_id string, tok_idx int, from int, to int, lemma string, xpos string, misc string, upos string").withColumn("feats", F.lit(None).cast("string"))
    xml = formats.morpho_xml(rows).select("text_id", F.lit("f").alias("foundry"), "xml")
    m = layers.morpho(xml).first()
    assert (m.lemma, m.xpos, m.misc, m.upos) == ("x&y", "ART|PIS", "0.9|0.1", "N")


def test_archives_round_trip(spark, tmp_path):
    archive.register(spark)
    docs = spark.createDataFrame([("C_D.1", '{"a":1}'), ("C_D.2", '{"b":2}')], "text_id string, json string")
    entries = archive.compress_entries(docs)
    entries.coalesce(1).write.format("index_tar").mode("append").save(str(tmp_path / "tar"))
    back = spark.read.format("index_tar").load(str(tmp_path / "tar" / "*.tar"))
    assert {r.name: bytes(r.content) for r in back.collect()} == {r.name: bytes(r.content) for r in entries.collect()}
    new = archive.compress_entries(spark.createDataFrame([("C_D.2", "{}"), ("C_D.9", "{}")], "text_id string, json string"))
    merged = {r.name: bytes(r.content) for r in archive.merge_tar(back, new).collect()}
    old = {r.name: bytes(r.content) for r in back.collect()}
    assert set(merged) == set(old) and merged["C-D-1.json.gz"] == old["C-D-1.json.gz"] and merged["C-D-2.json.gz"] != old["C-D-2.json.gz"]


CONLLU = "# foundry = cmc\n# filename = x\n# text_id = C_D.1\n# start_offsets = 0 0 4\n# end_offsets = 8 3 8\n2\tText\ttext\tN\tNN\t_\t0\tROOT\t_\t_\n\n"


def test_conllu(spark):
    files = spark.createDataFrame([("f", CONLLU)], "file string, content string")
    row = conllu.parse(files).first()
    assert (row.text_id, row.foundry, row.id, row["from"], row.to, row.feats) == ("C_D.1", "cmc", 2, 4, 8, None)
    assert conllu.parse(files, foundry="other").first().foundry == "other"
    morpho, dep = conllu.split_foundries(conllu.parse(files, foundry="marmot-malt"))
    assert (morpho.first().foundry, dep.first().foundry, dep.first().head_from) == ("marmot", "malt", 4)
    bad = spark.createDataFrame([("f", CONLLU.replace("# text_id = C_D.1\n", ""))], "file string, content string")
    assert conllu.parse(bad, strict=False).count() == 0
    with pytest.raises(Exception):
        conllu.parse(bad).collect()


def test_patch_is_idempotent(spark):
    old = spark.createDataFrame([("a", 0, "title", "t", "x"), ("a", 1, "lang", "t", "y"), ("a", 2, "title", "t", "z")], "text_id string, pos int, key string, type string, value string")
    new = spark.createDataFrame([("a", 0, "title", "t", "n"), ("a", 1, "award", "t", "w")], "text_id string, pos int, key string, type string, value string")
    once = index.patch_fields(old, new)
    rows = lambda df: [(r.pos, r.key, r.value) for r in df.orderBy("pos").collect()]
    assert rows(once) == [(0, "title", "n"), (1, "lang", "y"), (2, "award", "w")] == rows(index.patch_fields(once, new))


def test_external_command_fails_loudly(spark):
    with pytest.raises(Exception):
        annotate.pipe(spark.createDataFrame([("a", "b")], "text_id string, conllu string"), "false").collect()
    with pytest.raises(Exception):
        annotate.pipe(spark.createDataFrame([("a", "b")], "text_id string, conllu string"), "false", framed=False).collect()


def test_external_command_is_kept_and_started_again(spark, tmp_path):
    """One process answers many texts; one that ends after two texts is started again for the next."""
    (tmp_path / "once.py").write_text("import sys\nn = 0\nfor line in sys.stdin:\n    if line.startswith('# eof'): break\n    sys.stdout.write(line.upper() if line[0] != '#' else line)\n    if line == '# eot\\n':\n        sys.stdout.flush(); n += 1\n        if n == 2: break\n")
    rows = spark.createDataFrame([(f"t{i}", f"a\tb{i}\n\nc\n" + "x" * 200_000) for i in range(5)], "text_id string, conllu string").coalesce(1)
    got = {r.text_id: r.output for r in annotate.pipe(rows, f"python3 {tmp_path}/once.py").collect()}
    assert got == {f"t{i}": f"A\tB{i}\n\nC\n" + "X" * 200_000 + "\n" for i in range(5)}
    assert {r.text_id: r.output for r in annotate.pipe(rows, "tr a-z A-Z", framed=False).collect()}["t0"].startswith("A\tB0\n\nC\n")


def test_completion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (t, f) in enumerate([("a", "base"), ("b", "base"), ("a", "tt")]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"text_id": t, "foundry": f}))
    stream = spark.readStream.schema("text_id string, foundry string").json(str(tmp_path / "in"))
    q = complete_texts(stream, ["base", "tt"], None).writeStream.format("memory").queryName("done").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("done").collect()] == [("a", "base,tt", True)]


HEADER = """<idsHeader><fileDesc><textSigle>C/D.1</textSigle><analytic><h.title type="sub">Sub</h.title><h.title type="main">Main <!-- a -- b --> title</h.title><h.author> </h.author><biblNote n="url" rend="Seen">http://a.example</biblNote><biblNote>ID: U7 x</biblNote></analytic>
<monogr><h.author>M. Author</h.author><editor>Ed</editor><editor role="translator">Tr</editor></monogr><idno type="URN">urn:x:1</idno><idno type="ISBN">123</idno><pubPlace key="DE">Here</pubPlace>
<pubDate type="year">2020</pubDate><pubDate type="month">3</pubDate><pubDate type="day"/><note type="award" subtype="a"/><note type="award" subtype=" "/></fileDesc>
<textClass><catRef target="topic.culture.film"/><catRef target="topic.sport"/></textClass><catRef target="other.x"/><textDesc><textTypeArt>Bericht</textTypeArt><column>c</column></textDesc><link/><link target="http://l.example"/>
<xenoData><meta name="word" type="keyword" project="P">one</meta><meta name="n" type="string">1</meta><meta name="word" type="keyword" project="P">two</meta><meta name="n" type="string">2</meta><meta name="e" type="text">---</meta><meta name="u" type="what">x</meta>
<meta name="my_id" type="uri" desc="A b">http://x/y</meta><meta name="d" type="date">20200000</meta><meta name="f" type="attachment">v</meta></xenoData></idsHeader>"""


def test_header_fields(spark):
    rows = spark.createDataFrame([("a", HEADER, "own"), ("b", None, None), ("c", "<broken", None)], "text_id string, xml string, title string")
    got = {r.text_id: r.asDict() for r in headers.fields(rows).collect()}
    a = got["a"]
    want = {"sigle": "C/D.1", "title": "Main  title", "subTitle": "Sub", "author": "M. Author", "translator": "Tr", "editor": None, "ISBN": "123", "pubPlace": "Here", "pubPlaceKey": "DE", "pubDate": "2020-03", "creationDate": "2020-03", "award": ["a"], "textClass": ["culture", "film", "sport"]}
    want |= {"textType": "Berichten", "textColumn": "c", "externalLink": "http://l.example", "textExternalLink": "http://a.example", "textExternalLinkTitle": "Seen", "note": "U7", "language": "de", "availability": None}
    assert {k: a[k] for k in want} == want and a["URN"].urn == "urn:x:1"
    assert got["b"]["title"] is None and got["c"]["award"] == [] and len(got) == 3


def test_xeno_fields(spark):
    rows = headers.fields(spark.createDataFrame([("a", HEADER), ("b", None)], "text_id string, xml string"))
    got = [tuple(r)[2:] for r in meta.xeno_fields(rows).orderBy("pos").collect()]
    assert got == [
        ("P.word", "type:keywords", None, ["one", "two"]), ("n", "type:string", "2", None), ("myID", "type:attachement", "data:application/x.link;title=A%20b,http%3A%2F%2Fx%2Fy", None),
        ("d", "type:date", "2020", None), ("f", "type:attachement", "data:,v", None),
    ]
    assert {r.key for r in meta.xeno_fields(rows, "doc").collect()} >= {"P.docWord", "docN"}


def test_standoff_layers(spark):
    xml = """<standOff><metadataLayer xml:id="dom" type="classification"><textRef target="#T1"><catRef n="2" cert="0.5" target="#b"/><catRef n="1" cert="0.9" target="a"/><catRef target="z"/><catRef n="3" cert="0.1" target="c"/></textRef><textRef target=""><catRef target="x"/></textRef></metadataLayer>
<metadataLayer key="ext" type="links"><textRef target="T1"><ref target="http://a/b"> A </ref><ref target="http://c"/></textRef><textRef target="T2"><ref target="http://d"/></textRef></metadataLayer><metadataLayer><textRef target="T1"><catRef target="n"/></textRef></metadataLayer></standOff>"""
    entries = layers.standoff(spark.createDataFrame([(xml,)], "xml string"))
    got = {tuple(r)[:2]: (r.type, r.value_str, r.value_list) for r in meta.standoff_fields(entries, 0.4).collect()}
    assert got == {
        ("T1", "dom"): ("type:keywords", None, ["a", "b", "z"]), ("T1", "ext"): ("type:attachement", "data:application/x.link;title=A,http%3A%2F%2Fa%2Fb", None), ("T2", "ext"): ("type:attachement", "data:application/x.link;title=Link,http%3A%2F%2Fd", None),
    }


def test_constituency_xml_reads_back(spark):
    nodes = layers.constituency(spark.createDataFrame([("C_D.1", "f", CONST)], "text_id string, foundry string, xml string"))
    texts = spark.createDataFrame([("C_D.1",), ("none",)], "text_id string")
    xml = {r.text_id: r.xml for r in formats.constituency_xml(nodes, texts).collect()}
    assert xml["none"] == '<?xml version="1.0" encoding="UTF-8"?>\n'
    again = layers.constituency(spark.createDataFrame([("C_D.1", "f", xml["C_D.1"])], "text_id string, foundry string, xml string"))
    assert again.collect() == nodes.collect() and again.count() == 2


def test_counters(spark):
    texts = spark.createDataFrame([("a", 0, None), ("b", 3, " "), ("c", 2, "free"), ("d", None, "free")], "text_id string, tokens int, availability string")
    df, seen = counters.counted(texts, "texts", empty=F.col("tokens") == 0, unknown=meta.filled(F.col("availability")).isNull())
    assert df.count() == 4 and seen.get == {"rows": 4, "empty": 1, "unknown": 2}


def test_surface_inputs(zipped):
    annotated, base, other = (str(zipped / n) for n in ("c.tt.zip", "c.zip", "z.tt.zip"))
    assert archive.surface_inputs([annotated, base, other]) == [base, other]


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_tokens_of_odd_texts(spark, step):
    """Against a plain version: lists made at once, whatever texts share a step."""
    texts = [None, "", "  \n", "a", " Ein  Satz. Noch\neiner!\x0b", "e\u0301a\u00df_9 \U0001f648\U00010400|", "..a\r\n\r\nb", "x", None, "\u00e4."]
    rows = []
    for k, text in enumerate(texts):
        sent = n = 0
        closed = False
        for m in re.finditer(r"[ \t\n\r\f]+|(?:\w|\u0301)+|.", text or "", re.DOTALL):
            if m[0][0] in documents.SPACE:
                closed |= "\n" in m[0]
                continue
            sent += closed and n > 0
            rows.append((f"t{k}", n, m.start(), m.end(), m[0], int(sent)))
            n, closed = n + 1, m[0] in ".!?"
    df = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "text_id string, text string").coalesce(1)
    assert sorted(map(tuple, documents.unpacked(documents.packed(df, step)).collect())) == rows


@pytest.mark.parametrize("name", ["conllu_cols5", "dep_heads", "dep_inverse", "fill_empty_cells", "morpho_dep_merge", "now_lemma_only", "w2v_lemma", "conllu_rows", "conllu_texts", "morpho_join"])
def test_tokens_are_not_exchanged(spark, name):
    """Texts are dealt out once; no join, window or group of their tokens deals them anew, and none is written on the way."""
    before = set(os.listdir(storage.run_dir(spark)[7:])) if os.path.isdir(storage.run_dir(spark)[7:]) else set()
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(text_id" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert not os.path.isdir(storage.run_dir(spark)[7:]) or set(os.listdir(storage.run_dir(spark)[7:])) == before
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
