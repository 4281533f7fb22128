"""Sources and sinks on files of their own."""

import gzip
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tripleforge.operators import perturb
from tripleforge.sources import extraction, memo, shards, tables, workbook


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "sets" / "news" / "train"
    (folder / "more").mkdir(parents=True)
    (folder / "a.jsonl").write_text('{"id": 1, "text": "one\\ntwo", "n": 0.5}\n{"id": 2}\n')
    (folder / "more" / "b.json.gz").write_bytes(gzip.compress(b'{"n": 1.5, "id": 3, "text": null, "other": [1, {"x": 2}]}\n\n{"id": 4, "text": "\\u00e9"}'))
    (folder / "empty.json").write_text("")
    (folder / "_SUCCESS").write_text("")
    (folder / "_hidden.json").write_text('{"id": 9}')
    (folder / "notes.txt").write_text("no data")
    return tmp_path / "sets"


def test_shards_as_a_table(spark, corpus):
    hub = shards.Hub(spark, str(corpus))
    kinds = "id long, text string, n double"
    want = [(1, "one\ntwo", 0.5), (2, None, None), (3, None, 1.5), (4, "é", None)]
    df = hub.load("news", schema=kinds)
    assert df.columns == ["id", "text", "n"] and rows(df, "id", "text", "n") == want
    assert rows(hub.load("news", schema=kinds, columns=["n", "id"]), "id", "n") == [(i, n) for i, _, n in want]
    assert hub.load("news", columns=["id"]).schema.simpleString() == "struct<id:bigint>"
    assert hub.load("news").select("id").count() == 4 and hub.load("news", schema=kinds).rdd.getNumPartitions() == 3
    assert rows(hub.load("news", schema=kinds), "id") == rows(spark.read.schema(kinds).option("recursiveFileLookup", True).json([str(corpus / "news/train/a.jsonl"), str(corpus / "news/train/more/b.json.gz")]), "id")
    with pytest.raises(Exception, match="nowhere"):
        hub.load("nowhere", schema=kinds).count()
    (corpus / "none" / "train").mkdir(parents=True)
    assert hub.load("none", schema=kinds).count() == 0
    (corpus / "bad" / "train").mkdir(parents=True)
    (corpus / "bad" / "train" / "x.json").write_text('{"id": 1}\n{"id": ')
    with pytest.raises(Exception, match="x.json"):
        hub.load("bad", schema=kinds).count()


def test_shards_as_a_stream(spark, corpus, tmp_path):
    """Each file once, those that come later too."""
    hub, out = shards.Hub(spark, str(corpus)), str(tmp_path / "out")

    def run():
        stream = hub.load("news", schema="id long, text string", stream=True)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
        return rows(spark.read.parquet(f"{out}/rows"), "id")

    assert run() == [(1,), (2,), (3,), (4,)]
    time.sleep(0.05)
    (corpus / "news/train/c.jsonl").write_text('{"id": 5}\n')
    assert run() == [(1,), (2,), (3,), (4,), (5,)]


def test_tree_of_files_with_headers_of_their_own(spark, tmp_path):
    files = {
        "0.2/qa_small.csv": 'id,gold,context,"said, ""so"""\n1,0.5,0.25,"a ""b"", c"\n2,bad,,x\n', "0.7/qa_large.csv": "context,id,gold\n1,3,0\n", "notes/news_x_y.csv": "gold,extra,context,id,gold\n0.1,e,0.2,4,9\n",
        "0.2/plain.csv": "id,gold\n7,1\n", "Analysis_plot_temps/qa_small.csv": "id,gold,context\n8,1,1\n", "0.2/empty.csv": "", "0.2/readme.txt": "id,gold,context\n9,1,1\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    df = tables.read_tree(spark, str(tmp_path), ["gold", "context"])
    got = rows(df, "id", "gold", "context", "dataset", "model", "temperature")
    assert got == [("1", 0.5, 0.25, "qa", "small", 0.2), ("2", None, None, "qa", "small", 0.2), ("3", 0.0, 1.0, "qa", "large", 0.7), ("4", 0.1, 0.2, "news", "x_y", 0.0)]
    assert rows(df, "id", 'said, "so"', "extra") == [("1", 'a "b", c', None), ("2", "x", None), ("3", None, None), ("4", None, "e")]
    assert tables.read_tree(spark, str(tmp_path), ["nothing"]).count() == 0


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "out" / "book.xlsx")
    one = spark.createDataFrame([(2, "b & <c>\n\"q\" é", None, True, [["s", "p", "o"]]), (1, "  a  ", 0.1, False, []), (3, None, float("nan"), None, None), (4, "12", 1e300, None, None), (5, "", -2.0, True, None)], "id long, text string, x double, ok boolean, cells array<array<string>>")
    two = spark.createDataFrame([("k", 7)], "name string, n int")
    workbook.write_workbook({"first sheet": (one, ["id"]), "two": (two, ["name"])}, path)
    df = workbook.read_workbook(spark, path, "first sheet", "id long, text string, x double, ok boolean, cells string")
    assert [tuple(r) for r in df.collect()] == [(1, "  a  ", 0.1, False, "[]"), (2, "b & <c>\n\"q\" é", None, True, '[["s","p","o"]]'), (3, None, None, None, None), (4, "12", 1e300, None, None), (5, "", -2.0, True, None)]
    assert [tuple(r) for r in workbook.read_workbook(spark, path, "two").collect()] == [("k", "7")]
    assert workbook.read_workbook(spark, path).columns == ["id", "text", "x", "ok", "cells"]
    workbook.write_workbook({"only": (two.limit(0), ["name"])}, path)  # again, in the place of the first
    assert workbook.read_workbook(spark, path).count() == 0 and os.listdir(tmp_path / "out") == ["book.xlsx"]
    with pytest.raises(ValueError, match="sheet"):
        workbook.write_workbook({"a/b": (two, ["name"])}, path)


def test_workbook_of_another_program(spark, tmp_path):
    """Shared strings in runs, gaps between cells, cells without a place, errors."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{links}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="t" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si><si><t/></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>5</v></c><c r="B3"><v>9</v></c><c r="C3" t="e"><v>#N/A</v></c></row><row><c><v>6.5</v></c><c/><c t="s"><v>2</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in workbook.read_workbook(spark, str(tmp_path)).collect()] == [("5", "#N/A"), ("6.5", "")]
    assert [workbook.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and workbook.column_number("AAA12") == 702


def test_one_rate_for_all_tasks(spark, tmp_path):
    """Four tasks at once: the gaps between all their calls are the spacing's at least."""
    folder, spacing = str(tmp_path), 0.2

    def client():
        def ask(text):
            with open(f"{folder}/{text}", "w") as f:
                f.write(repr(time.time()))
            return '{"kg_1": [["a", "b", "c"]]}'

        return ask

    df = spark.range(16).select(F.concat(F.lit("q"), "id").alias("q"))
    assert extraction.extract(df, "q", client, extraction.Policy(spacing=spacing), tasks=4).count() == 16
    at = sorted(float(open(f"{folder}/{name}").read()) for name in os.listdir(folder))
    gaps = [b - a for a, b in zip(at, at[1:])]
    assert len(at) == 16 and min(gaps) > 0.7 * spacing and at[-1] - at[0] >= 14.5 * spacing


def test_turns_never_meet():
    now, calls = [100.03], []

    def pause(seconds):
        now[0] += seconds

    turns = [extraction.Turns(0.5, k, 3, pause, lambda: now[0]) for k in range(3)]
    for k in (0, 0, 2, 1, 1, 0):
        turns[k].wait()
        calls.append((round(now[0] / 0.5), k))
    assert all(slot % 3 == k for slot, k in calls) and len({slot for slot, _ in calls}) == 6


def test_stop_rule():
    good = ['{"kg_1": [["a", "b", "c"]]}', '```json\n{"kg_1": [], "kg_2": [["x", "Relation", "y"]]}\n```', 'text {"kg_1": [["a", "b"], ["a", "b", "c"]]} text']
    bad = [None, "", "junk", "[]", '{"kg_1": []}', '{"kg_1": [["a", "b"]]}', '{"kg_1": [["Entity1 ", "b", "c"]]}', '{"kg_1": [["a", "b", 3]]}', '{"kg_1": "abc"}']
    assert all(map(extraction.holds_graph, good)) and not any(map(extraction.holds_graph, bad))


def test_answers_over_runs(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def client(fails):
        def make():
            def ask(text):
                with open(f"{calls}/{text}", "a") as f:
                    f.write("x")
                if text in fails:
                    raise RuntimeError(f"no {text}")
                return json.dumps({"kg_1": [[text, "is", "b"]]})

            return ask

        return make

    df = spark.createDataFrame([(1, "one"), (2, "two"), (2, "two b"), (None, "none"), (3, "three")], "id long, q string")
    path, options = str(tmp_path / "answers"), {"pause": lambda s: None}
    first = extraction.extract_stored(df, "id", "q", path, client({"two", "three"}), **options)
    assert {r.id for r in first.where("answer is not null").collect()} == {1}
    second = extraction.extract_stored(df, "id", "q", path, client({"three"}), **options)
    assert {r.id for r in second.where("answer is not null").collect()} == {1, 2} and second.count() == 5
    for _ in range(4):
        extraction.extract_stored(df, "id", "q", path, client({"three"}), most_runs=3, **options)
    stored = rows(spark.read.parquet(path), "id", "run", "problem")
    assert stored == [(1, 1, None), (2, 1, "no two"), (2, 2, None), (3, 1, "no three"), (3, 2, "no three"), (3, 3, "no three")]
    assert len(open(f"{calls}/one").read()) == 1 and len(open(f"{calls}/two").read()) == 3 + 1


def test_each_sentence_is_translated_once(spark, tmp_path):
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def make():
        def ask(texts):
            for t in texts:
                with open(f"{calls}/{abs(hash(t))}", "a") as f:
                    f.write("x")
            return [None if "lost" in t else t.upper() for t in texts]

        return ask

    def back():
        return lambda texts: [t.lower() for t in texts]

    data = [(1, "Hello there. How are you?"), (2, "How are you? Hello there. New one."), (3, "All is lost. Hello there."), (4, ""), (5, None), (6, "same. same.")]
    df = spark.createDataFrame(data, "id long, text string")
    want = [(1, "hello there. how are you?"), (2, "how are you? hello there. new one."), (3, None), (4, None), (5, None), (6, None)]
    for _ in range(2):
        made = memo.there_and_back(df, "id", perturb.sentences(F.col("text")), str(tmp_path / "memo"), make, back, perturb.sentences)
        assert rows(made, "id", "made") == want
    assert len(os.listdir(calls)) == 5 and all(len(open(f"{calls}/{f}").read()) == 1 for f in os.listdir(calls))


def test_sentences_are_moved_as_marks(spark, tmp_path):
    """Rows meet the store by marks, so a sentence is shuffled once to be told apart and not again; only one job asks."""
    df = spark.createDataFrame([(1, "A b. C d."), (2, "C d. A b."), (3, None)], "id long, text string")
    made = memo.mapped_sentences(df, "id", perturb.sentences(F.col("text")), str(tmp_path / "memo"), lambda: lambda texts: [t.upper() for t in texts])
    assert rows(made, "id", "made") == [(1, "A B. C D."), (2, "C D. A B."), (3, None)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "_mark" in plan and plan.count("Aggregate") == 1  # the distinct texts aren't sought once more
