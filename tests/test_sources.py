"""Registries, schema imports, Java source, logs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import files, java, jobs, logs, registry, schemas
from weftline.streaming import ingest

YAML = """repo: "o/n"
branch: main
# a comment
scope:
  - "src/**/*.java"
mappers:
  - id: m1
    sourceFile: src/a/M.java
    class: a.M
    targetType: a.T
    extra:
      deep: 1
  - id: m2
    sourceFile: ''
"""


def test_registry(spark, tmp_path):
    p = tmp_path / "r.yaml"
    p.write_text(YAML)
    found = registry.load(str(p))
    m = registry.mappers(spark, found)
    assert [r.id for r in m.collect()] == ["m1", "m2"]
    codes = {(r.mapper_id, r.code) for r in registry.check(m, spark.createDataFrame([("src/a/M.java",)], "path string")).collect()}
    assert ("m1", "targetType-unresolved") in codes and ("m2", "missing-sourceFile") in codes and ("m1", "sourceFile-missing") not in codes
    registry.assert_in_scope("src/x/A.java", found["scope"])
    with pytest.raises(ValueError, match="scope"):
        registry.assert_in_scope("lib/A.java", found["scope"])
    assert registry.parse_slug("o/n") == ("o", "n")
    p.write_text("repo: x\nbranch: y\n")
    with pytest.raises(ValueError, match="scope"):
        registry.load(str(p))


def test_json_sample():
    node = schemas.import_schema("payload-json", json.dumps({"a": 1.0, "b": 1.5, "d": "2024-01-02x", "n": None, "o": {"x": True}, "l": [{"y": 1}, {"z": 2}], "e": [], "s": ["2024-01-02"]}))
    assert [(p, t) for p, t, _, _ in schemas.flatten(node)] == [("a", "integer"), ("b", "number"), ("d", "date"), ("n", "string"), ("o", "object"), ("o.x", "boolean"), ("l[]", "array"), ("l[].y", "integer"), ("e[]", "array<string>"), ("s[]", "array<date>")]
    assert schemas.count(node) == 10
    with pytest.raises(ValueError):
        schemas.import_schema("payload-json", "null")


def test_json_schema_looks_up_required_in_the_property():
    text = json.dumps({"type": "object", "properties": {"a": {"type": "string", "required": ["a"], "description": "d"}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "integer"}}}}}, "required": ["b"]})
    assert schemas.flatten(schemas.import_schema("payload-json", text)) == [("a", "string", True, "d"), ("b[]", "array", False, None), ("b[].c", "integer", False, None)]


def test_xml_and_xsd():
    node = schemas.import_schema("payload-xml", '<r id="2024-01-01"><i n="1"/><i/><t>text</t></r>', "root")
    assert [(p, t) for p, t, _, _ in schemas.flatten(node)] == [("r", "object"), ("r.@id", "date"), ("r.i[]", "array"), ("r.i[].@n", "string"), ("r.t", "string")]
    xsd = "".join(f'<xs:element name="e{i}" type="xs:decimal"/>' for i in range(60))
    assert schemas.count(schemas.import_schema("xsd", xsd)) == 50


def test_validation_and_search():
    doc = {"version": 1, "mapperId": "m", "savedAt": "x", "source": {"method": "manual", "root": {"id": "1", "name": "r", "type": "odd"}}, "target": {"method": "?", "root": {"id": "2", "name": "t", "type": "object"}}}
    assert schemas.errors(doc) == ["source.root: type odd", "target: method ?"]
    tree = {"name": "r", "type": "object", "children": [{"name": "Alpha", "type": "string"}, {"name": "b", "type": "string"}]}
    assert [c["name"] for c in schemas.search_tree(tree, "LPH")["children"]] == ["Alpha"]
    assert schemas.spark_type(tree).simpleString() == "struct<Alpha:string,b:string>"


CODE = """package p;
// Target t = fake; t.setFake(1);
public class M extends Base {
  private static String clean(String s) { return s.trim(); }
  Target map(Source s) {
    Target t = new Target();
    t.setName(clean(s.getName("a)b")));
    if (s.kind().equals("EXPRESS")) {
      t.priority = true;
    } else {
      t.priority = false;
    }
    list.forEach(t::setTag);
    t.put("key", s.getKey());
    t.withSize(1);
    Opaque.fill(t);
    return Target.builder().code(s.c()).note("x").build();
  }
}
class Target { private String name; private boolean priority; private List<String> tags = new ArrayList<>(); public String getCity() { return null; } }
"""


def test_java_structure(spark):
    s = java.Source(CODE)
    assert [(c["name"], c["parent"]) for c in s.classes] == [("M", "Base"), ("Target", None)]
    assert [(m["class_name"], m["name"], m["is_helper"]) for m in s.methods] == [("M", "clean", True), ("M", "map", False), ("Target", "getCity", False)]
    assert [(f["name"], f["type"]) for f in s.fields] == [("name", "String"), ("priority", "boolean"), ("tags", "List<String>")]
    sites = s.write_sites("Target")
    assert [(w["target_field"], w["via"]) for w in sites] == [("name", "setter"), ("priority", "assignment"), ("priority", "assignment"), ("tag", "setter"), ("key", "map-put"), ("size", "setter"), ("code", "builder"), ("note", "builder")]
    assert sites[0]["expression"] == 'clean(s.getName("a)b"))' and sites[0]["in_method"] == "map"
    assert [f["name"] for f in s.target_fields("Target")] == ["name", "priority", "tags", "city"]
    at = CODE.index("t.priority = false")
    assert s.guards(at) == ['if (s.kind().equals("EXPRESS"))', "else"]
    assert java.control_flow(s.guards(at)) == ["// control flow:", 'if (s.kind().equals("EXPRESS")) { … } else']
    loose = java.scan(spark.createDataFrame([("M.java", CODE)], "path string, text string"), "loose_writes")
    assert [r.hint for r in loose.orderBy("line").collect()] == ["setter-like call", "method-reference setter", "fluent with* call"]
    assert ("Opaque", "t") in [(c["callee"], c["args"]) for c in s.calls()]
    df = spark.createDataFrame([("a", CODE), ("b", None)], "path string, text string")
    assert java.scan(df, "write_sites", "Target").count() == 8


CORPUS = """package p;
class Corpus {
  private Target kept;
  Target all(Source s, Map<String, Object> m) {
    Target a = new Target(), other = null;
    a.setPlain(s.x());
    a.direct = s.y();
    this.kept.setHeld(1);
    var made = new p.Target();
    made.withFluent(f(1, g(2))).withLater(3);
    made.put("quoted", s.get("a,b"));
    if (s.ok()) { a.setGuarded(1); }
    for (Target t : s.targets()) { t.setLooped(t.getLooped()); }
    s.names().forEach(a::setReferenced);
    Other o = new Other();
    o.setNot(1);
    a.same == 2;
    return Target.builder().built(1).last(h("(")).build().setAfter(3);
  }
  void one(Other a) { a.setOther(1); }
  void two(List<Target> list, Target t) {
    list.forEach((Target u) -> { u.setInLambda(1); });
    Other t2 = null; t2.setNo(1);
    { Other t3 = null; t3.setNo(2); }
    t3 = new Target();
    t3.setLate(1);
  }
}
"""


def test_write_sites_by_shape_and_scope():
    sites = java.Source(CORPUS).write_sites("Target")
    got = [(w["target_field"], w["via"], w["receiver"], w["in_method"]) for w in sites]
    assert got == [
        ("plain", "setter", "a", "all"), ("direct", "assignment", "a", "all"), ("held", "setter", "kept", "all"),
        ("fluent", "setter", "made", "all"), ("quoted", "map-put", "made", "all"), ("guarded", "setter", "a", "all"),
        ("looped", "setter", "t", "all"), ("referenced", "setter", "a", "all"), ("built", "builder", "Target.builder()", "all"),
        ("last", "builder", "Target.builder()", "all"), ("inLambda", "setter", "u", "two"), ("late", "setter", "t3", "two"),
    ]
    assert [w["expression"] for w in sites if w["target_field"] in ("fluent", "quoted", "last", "referenced")] == ["f(1, g(2))", 's.get("a,b")', java.REFERENCE, 'h("(")']
    assert sites[0]["statement"] == "a.setPlain(s.x());"


def test_guards_of_many_blocks_are_found_in_one_pass():
    text = "class A { void f() { for (int i = 0; i < 3; i++) { if (a(1)) { x(); } else if (b) { y(); } else { z(); } } " + "if (q) { r(); } " * 3000 + "do { w(); } while (t); } }"
    s = java.Source(text)
    assert s.guards(text.index("x()")) == ["for (int i = 0; i < 3; i++)", "if (a(1))"]
    assert s.guards(text.index("y()")) == ["for (int i = 0; i < 3; i++)", "if (a(1))", "else if (b)"]
    assert s.guards(text.index("z()")) == ["for (int i = 0; i < 3; i++)", "else if (b)", "else"]
    assert s.guards(text.index("w()")) == ["do"] and s.guards(text.rindex("r()")) == ["if (q)"]


def test_tags_and_attributes_of_odd_texts():
    text = '<?xml v="1"?><!-- <c n="x"/> --><r a = "1" b=\'2\' a="3" "z" q="a>b"><x/> 1 < 2 <é/></r></r><s'
    assert [t[:2] for t in schemas.tags(text)] == [("empty", "c"), ("open", "r"), ("empty", "x"), ("close", "r"), ("close", "r")]
    assert schemas.attributes(' a = "1" b=\'2\' a="3" "z" = "y"') == [("a", "1"), ("a", "3")]
    assert schemas.xml_tree("<a/><b><c></b>")["tag"] == "b" and schemas.xml_tree("<b><c></b>")["children"][0]["tag"] == "c"
    xsd = '<xs:element name="a" type="xs:integer"><xs:element name="b" type="integer"/></xs:element><xs:element ref="q"/><xs:element>'
    assert [(n["name"], n["type"]) for n in schemas.from_xsd(xsd)["children"]] == [("a", "integer"), ("b", "string"), ("element", "string")]
    with pytest.raises(ValueError):
        schemas.xml_tree("no tags")


def test_scrub_keeps_lines():
    assert java.scrub("a // b\nc") == "a     \nc" and java.scrub("/* x\ny */z") == "    \n    z"


def test_logs(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    logs.append(spark.createDataFrame([("2024", "m", "f", "c", "e", "d")], logs.DEFECTS), path)
    logs.append(spark.createDataFrame([("2025", "m", "f", "c", "e", "d")], logs.DEFECTS), path)
    assert logs.read(spark, path, logs.DEFECTS).count() == 2
    (tmp_path / "log" / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        logs.read(spark, path, logs.DEFECTS).collect()
    assert logs.read(spark, path, logs.DEFECTS, strict=False).count() == 2


def test_file_tree(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "target").mkdir()
    (tmp_path / "src" / "a" / "A.java").write_text("class A {}")
    (tmp_path / "target" / "B.java").write_text("class B {}")
    got = files.tree(spark, f"file://{tmp_path}", ".java")
    assert [r.path for r in got.collect()] == ["src/a/A.java"]
    sha = files.tree_hash(got).first().sha
    (tmp_path / "src" / "a" / "A.java").write_text("class A { }")
    assert len(sha) == 40 and files.tree_hash(files.tree(spark, f"file://{tmp_path}", ".java")).first().sha != sha


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    files.put(spark.createDataFrame([("m", "1", 1), ("n", "1", 1)], "mapper_id string, fingerprint string, v int"), path, ["mapper_id", "fingerprint"])
    files.put(spark.createDataFrame([("m", "1", 2)], "mapper_id string, fingerprint string, v int"), path, ["mapper_id", "fingerprint"])
    assert {(r.mapper_id, r.v) for r in files.get(spark, path).collect()} == {("m", 2), ("n", 1)}
    assert files.get(spark, path, mapper_id="n").count() == 1


def test_polling_takes_new_files_once(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    seen = []
    base = ingest.merger(out, ingest.newest("k", "v"))

    def merge(batch, number):
        seen.append(batch.count())
        base(batch, number)

    for rows in ([("a", 1), ("b", 5)], [("a", 3)]):
        spark.createDataFrame(rows, "k string, v int").write.mode("append").json(src)
        ingest.poll(spark, src, "k string, v int", cp, merge).awaitTermination()
    assert seen == [2, 1]
    assert {(r.k, r.v) for r in ingest.current(spark, out, ingest.newest("k", "v")).collect()} == {("a", 3), ("b", 5)}


def test_poll_plan(spark):
    changed = spark.createDataFrame([("src/A.java",)], "path string")
    mappers = spark.createDataFrame([("m", "src/A.java")], "id string, source_file string")
    state = spark.createDataFrame([("old",)], "last_sha string")
    plan = lambda s, head, c: tuple(ingest.plan_scan(s, head, c, ["src/**"], mappers).first())
    assert plan(state, "new", changed) == ("incremental", ["m"])
    assert plan(state, "old", changed) == ("skip", [])
    assert plan(state.limit(0), "new", changed) == ("full", [])
    assert plan(state, "new", changed.withColumn("path", F.lit("lib/x"))) == ("advance", [])


def test_jobs_and_results(spark, tmp_path):
    from weftline.sources import jobs

    f = spark.createDataFrame([("m", "Name", "mapped", "s1"), ("m", "note", "unresolved", "s2"), ("m", "gone", "unmapped", None)], "mapper_id string, field string, state string, slice string")
    job = jobs.export_job(f, spark.createDataFrame([("m", "fp")], "mapper_id string, fingerprint string"))
    jobs.write_documents(job, f"file://{tmp_path}/jobs")
    back = jobs.read_documents(spark, f"file://{tmp_path}/jobs", jobs.JOB)
    assert [(x.field, x.slice) for x in back.first().fields] == [("Name", "s1"), ("note", None)]
    done = spark.createDataFrame([("m", "fp", [("name", True, [("READ", "a", None, None, None)]), ("note", False, [])]), ("m", "old", [("note", True, [("READ", "a", None, None, None)])])], jobs.RESULT)
    ok, gaps = jobs.import_results(back, done)
    assert [(r.field, r.slice) for r in ok.collect()] == [("Name", "s1")] and [r.field for r in gaps.collect()] == ["note"]
    assert jobs.views(ok, "field").first().json.startswith('{"mapper_id":"m"')


def test_paths_stay_inside():
    from weftline.sources.jobs import inside

    assert inside("/w", "a/./b/../c.java") == "/w/a/c.java"
    for bad in ("../x", "a/../../x", "/etc/x"):
        with pytest.raises(ValueError):
            inside("/w", bad)


def test_goldens(spark, tmp_path):
    from weftline.operators.store import compare_golden
    from weftline.sources import jobs

    (tmp_path / "g.json").write_text('{"mapper_id": "m",\n "fields": [{"target_field": "channel", "pipeline_kinds": ["CONSTANT"]}]}')
    g = jobs.goldens(jobs.read_documents(spark, f"file://{tmp_path}/g.json", jobs.GOLDEN))
    now = jobs.seed_store(g, "fp", "2024").withColumn("pos", F.lit(0))
    assert compare_golden(g, now).first().outcome == "matched"


def plain_paths(html):
    """Paths and types by a stack of nested dicts, in the order of first children."""
    import re

    top = {"kids": [], "attrs": []}
    stack = [top]
    for close, tag, rest, end in re.findall(r"<(/?)([\w:-]+)([^>]*?)(/?)>", html):
        if close:
            del stack[max(1, len(stack) - 1) :]
            continue
        el = {"tag": tag, "kids": [], "attrs": re.findall(r'([\w:-]+)\s*=\s*"([^"]*)"', rest)}
        if len(stack) == 1:
            top["kids"] = []
        stack[-1]["kids"].append(el)
        stack += [] if end else [el]
    out = []

    def visit(el, path):
        out.extend(f"{path}@{k}" for k, _ in el["attrs"])
        for tag in dict.fromkeys(k["tag"] for k in el["kids"]):
            own = [k for k in el["kids"] if k["tag"] == tag]
            here = path + tag + ("[]" if len(own) > 1 else "")
            out.append(here)
            visit(own[0], f"{here}.")

    visit(top, "")
    return out


def test_xml_flatten_pages_reads_each_page(spark, tmp_path):
    import __spark_entry__

    run = __spark_entry__.queries()["xml_flatten_pages"]
    pages = [(1, '<html lang="en"><body><p>a</p><p id="1">b</p><hr/></body></html>'), (2, "<a><b n=\"2\"/></a>"), (3, "no element"), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.path) for r in run(spark, str(tmp_path)).orderBy("page_id", "pos").collect()]
    assert got == [(1, p) for p in ("html", "html.@lang", "html.body", "html.body.p[]", "html.body.hr")] + [(2, p) for p in ("a", "a.b", "a.b.@n")]
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    got = [(r.page_id, r.path) for r in run(spark, "/root/testdata/sf0.001").orderBy("page_id", "pos").collect()]
    assert got == [(r.page_id, p) for r in sorted(given, key=lambda r: r.page_id) for p in plain_paths(r.html)]


def test_merges_are_the_same_when_repeated_and_keep_two_versions(spark, tmp_path):
    import os

    path = f"file://{tmp_path}/t"
    keep = ingest.newest("k", "v")
    merge = ingest.merger(path, keep)
    batches = [[(k, 1, f"a{k}") for k in range(20)], [(3, 2, "b"), (3, 2, "c"), (40, 1, "d")], [(5, 0, "old")], [(7, 9, "e")]]
    want = {}
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k long, v int, name string")
        merge(df, number)
        once = sorted(map(tuple, ingest.current(spark, path, keep).collect()))
        merge(df.orderBy("name", ascending=False), number)  # handed over again, in another order
        assert sorted(map(tuple, ingest.current(spark, path, keep).collect())) == once
        for k, v, name in rows:
            want[k] = max(want.get(k, (v, name)), (v, name))
        assert once == sorted((k, *x) for k, x in want.items())
    files = [d for d, _, fs in os.walk(tmp_path / "t") if "_SUCCESS" in fs and "/versions/" in d]
    assert len(files) == 2
    assert ingest.current(spark, f"file://{tmp_path}/none", keep) is None


def test_merges_write_in_proportion_to_the_batch(spark, tmp_path):
    """A table of 20,000 keys and batches of ten: the large part stays as it is while the small ones grow."""
    import os

    path, keep = f"file://{tmp_path}/t", ingest.newest("k", "v")
    merge = ingest.merger(path, keep)
    merge(spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("v")), 0)

    def written():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_size for d, _, fs in os.walk(tmp_path / "t") for f in fs if f.endswith(".parquet") and "/versions/" not in d}

    first = written()
    for number in range(1, 6):
        before = written()
        merge(spark.range(10).select((F.col("id") * 7).alias("k"), F.lit(number + 1).alias("v")), number)
        after = written()
        assert first.items() <= after.items()  # not rewritten
        assert sum(after[f] for f in after.keys() - before.keys()) < 0.2 * sum(first.values())
    got = {r.k: r.v for r in ingest.current(spark, path, keep).collect()}
    assert len(got) == 20_000 and got[7] == 6 and got[8] == 1
    merge(spark.range(40_000).select(F.col("id").alias("k"), F.lit(9).alias("v")), 6)  # as large as the table: all parts become one
    assert len(ingest.versions_of(spark, path)[6]) == 1 and ingest.current(spark, path, keep).where("v = 9").count() == 40_000


def test_report_reads_new_files_only(spark, tmp_path):
    """Sums, means and rates after every call equal those of all rows; a file that was read may be gone."""
    import os

    from weftline.operators import journal

    src, cp, path = (f"file://{tmp_path}/{x}" for x in ("in", "cp", "states"))
    schema = "mapper_id string, at string, declared long, unmapped long, agree_rate double"
    turns = [[("a", "2024-01-01", 3, 1, 0.5), ("b", "2024-01-02", 4, None, None)], [("a", "2024-01-03", 5, 2, None), ("a", None, 9, 9, 1.0)], [("c", "2024-01-02", 1, 0, 1.0), ("a", "2023-01-01", 7, 7, 0.0)], []]
    all_ = []
    for rows_ in turns:
        all_ += rows_
        if rows_:
            spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").json(src)
        out = ingest.report(spark, src, schema, cp, path, ["declared", "unmapped"], ["mapper_id"], since="2024-01-01")
        df = journal.runs(spark.createDataFrame(all_, schema), since="2024-01-01")
        want = df.groupBy("mapper_id").agg(F.count("*").alias("runs"), F.sum("declared"), F.coalesce(F.sum("unmapped"), F.lit(0)), F.round(F.sum("declared") / F.count("*"), 4), F.round(F.coalesce(F.sum("unmapped"), F.lit(0)) / F.count("*"), 4), F.coalesce(F.round(F.avg("agree_rate"), 4), F.lit(1.0)), F.max("at"))
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
        for f in os.listdir(tmp_path / "in"):
            if f.endswith(".json"):
                open(tmp_path / "in" / f, "w").close()  # what was read is not asked again


def test_a_scan_notes_its_commit_only_when_it_succeeded(spark, tmp_path):
    path, seen = f"file://{tmp_path}/state", []
    m = spark.createDataFrame([("a", "src/A.java"), ("b", "src/B.java")], "id string, source_file string")

    def run(head, changed, scan=seen.append):
        return ingest.scan_once(spark, path, "o/n", head, spark.createDataFrame([(c,) for c in changed], "path string"), ["src/**/*.java", "src/*.java"], m, scan)

    def fails(ids):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        run("s1", [], fails)
    assert ingest.last_sha(spark, path, "o/n") is None
    assert run("s1", []) == {"action": "scan", "mode": "full", "mappers": ["a", "b"]}
    assert run("s1", ["src/A.java"])["reason"] == "same_sha"
    assert run("s2", ["src/A.java", "doc/x.md"]) == {"action": "scan", "mode": "incremental", "mappers": ["a"]}
    assert run("s3", ["doc/x.md"])["reason"] == "no_in_scope_changes" and run("s4", ["src/New.java"])["reason"] == "changed_not_registered"
    assert ingest.last_sha(spark, path, "o/n") == "s4" and seen == [["a", "b"], ["a"]]


def test_schema_documents_are_validated(spark, tmp_path):
    side = {"method": "manual", "root": {"id": "r", "name": "r", "type": "object", "children": []}}
    good = json.dumps({"version": 1, "mapperId": "m", "savedAt": "x", "source": side, "target": side})
    path, df = f"file://{tmp_path}/s", lambda rows: spark.createDataFrame(rows, "mapper_id string, text string")
    schemas.save_documents(df([("m", good), ("n", good)]), path)
    assert [r.mapper_id for r in schemas.load_documents(spark, path, "n").collect()] == ["n"]
    with pytest.raises(Exception, match="version is not 1"):
        schemas.save_documents(df([("m", good.replace("1,", "2,", 1))]), path)
    assert schemas.load_documents(spark, path).count() == 2


def test_caches_skip_what_they_cannot_read(spark, tmp_path):
    c = files.Cache(spark, f"file://{tmp_path}", "field", "v int")
    c.put(spark.createDataFrame([("k", 1), ("k", 2), ("j", 3)], "key string, v int"))
    c.put(spark.createDataFrame([("k", 5)], "key string, v int"))
    (tmp_path / "field" / "key=j" / "bad.json").write_text("{oops\n")
    assert sorted((r.key, r.v) for r in c.list().collect()) == [("j", 3), ("k", 5)] and [r.v for r in c.get("k").collect()] == [5]
    c.clear()
    assert not (tmp_path / "field").exists()
    with pytest.raises(ValueError, match="cache"):
        files.Cache(spark, f"file://{tmp_path}", "other", "v int")
    files.put(spark.createDataFrame([("m", 1, "a"), ("n", 2, "b")], "mapper_id string, format int, v string"), f"file://{tmp_path}/store", ["mapper_id"])
    assert files.get_entry(spark, f"file://{tmp_path}/store", mapper_id="m").count() == 1 and files.get_entry(spark, f"file://{tmp_path}/store", mapper_id="n").count() == 0


def test_sources_and_worktrees(spark, tmp_path):
    m = spark.createDataFrame([("m", "src/A.java")], "mapper_id string, source_file string")
    tree = spark.createDataFrame([("src/A.java", "text")], "path string, text string")
    assert files.resolve_sources(m, tree.limit(0), worktree=tree).first()[:] == ("m", "text", "worktree")
    with pytest.raises(Exception, match="not in the worktree"):
        files.resolve_sources(m, tree, worktree=tree.limit(0)).collect()
    entry = spark.createDataFrame([("m", "src/A.java", "a.M", "map", "a.S", "a.T", None)], ", ".join(f"`{c}` string" for c in registry.COLUMNS))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("class A {}")
    codes = lambda w: {r.code for r in registry.check_worktree(entry, w).collect()}
    assert codes(f"file://{tmp_path}/gone") == {"worktree-missing", "no-worktree"} and "sourceFile-missing" not in codes(f"file://{tmp_path}")
    assert files.tree(spark, f"file://{tmp_path}", ".java", limit=1).first()[:] == ("src/A.java", "class A {}", 10)


def test_selectors_have_to_be_covered(spark):
    from weftline.operators.labeling import label_from_cache

    none = spark.createDataFrame([], "mapper_id string, fingerprint string, field string, pipeline array<string>, updated_at string")
    f = spark.createDataFrame([("m", "a.name"), ("m", "b")], "mapper_id string, field string")
    cache = spark.createDataFrame([("m", "x", "a.name", ["READ"], "1"), ("m", "y", "a.name", ["CONSTANT"], "2")], none.schema)
    now = spark.createDataFrame([("m", "z")], "mapper_id string, fingerprint string")
    s = lambda *names: spark.createDataFrame([("m", n) for n in names], "mapper_id string, selector string")
    got = label_from_cache(f, none.drop("updated_at"), cache, now, s("Name"))
    assert sorted((r.field, r.pipeline, r.source) for r in got.collect()) == [("a.name", ["CONSTANT"], "older"), ("b", None, None)]
    with pytest.raises(ValueError, match="zip"):
        label_from_cache(f, none.drop("updated_at"), cache, now, s("name", "zip"))


def test_scanner_is_linear_in_a_file():
    """A file of one megabyte with a write, a builder and a block on nearly every line; twice the file takes about twice as long."""
    import time

    from weftline.sources.java import Source

    def took(n):
        body = "\n".join(f"    if (s.a{i}()) {{ t.setF{i}(s.get(\"{i}\")); }}" for i in range(n))
        methods = "\n".join(f"  T m{i}(S s) {{ T t = T.builder().a(s.b()).build(); return t; }}" for i in range(n // 4))
        code = f"class M {{\n  T f(S s) {{\n    T t = new T();\n{body}\n    return t;\n  }}\n{methods}\n}}"
        began = time.process_time()
        source = Source(code)
        sites = source.guarded_sites("T")
        return time.process_time() - began, len(sites), len(code)

    took(500)
    (one, n, _), (two, n2, size) = took(8000), took(16000)
    assert (n, n2) == (8000 + 2000, 16000 + 4000) and size > 1_000_000
    assert two < 3.2 * one, (one, two)


def test_snapshots_tell_what_changed(spark, tmp_path):
    """Against sets of paths, for random trees; partitions of equal folders are not read."""
    import random

    import re

    from weftline.sources import snapshots

    rng = random.Random(6)
    path = lambda: "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))) + "/f" + str(rng.randrange(6))
    trees = [{path().lstrip("/"): str(rng.randrange(3)) for _ in range(60)}]
    trees.append({p: c for k, (p, c) in enumerate(trees[0].items()) if k % 9} | {"a/b/new": "1", "top": "2"} | {p: c + "!" for p, c in [*trees[0].items()][4:6]})
    trees += [{}, dict([*trees[0].items()])]
    for k, t in enumerate(trees):
        snapshots.write(spark.createDataFrame(list(t.items()), "path string, content string"), f"file://{tmp_path}/{k}")
    for a, b in ((0, 1), (1, 0), (0, 2), (2, 0), (0, 3), (2, 2)):
        want = {(p, "added" if p not in trees[a] else "removed" if p not in trees[b] else "changed") for p in {*trees[a]} | {*trees[b]} if trees[a].get(p) != trees[b].get(p)}
        assert {tuple(r) for r in snapshots.changed(spark, f"file://{tmp_path}/{a}", f"file://{tmp_path}/{b}").collect()} == want, (a, b)
    deep = {f"x{k}/y{j}/z": "1" for k in range(30) for j in range(3)}
    for k, t in enumerate((deep, deep | {"x7/y1/z": "2"})):
        snapshots.write(spark.createDataFrame(list(t.items()), "path string, content string"), f"file://{tmp_path}/deep{k}")
    roots = [f"file://{tmp_path}/deep{k}" for k in range(2)]
    assert sorted(r.folder for r in snapshots.unequal(spark, *roots).collect()) == ["", "x7", "x7/y1"]
    plan = snapshots.changed(spark, *roots)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)", plan)
    assert len(read) == 2 and all(len(x.split(",")) == 3 for x in read)


def test_newest_files_by_time(spark, tmp_path):
    import os

    from pyspark.errors import AnalysisException

    for at, (name, text) in enumerate([("m/f1/a.json", '{"v": 1}'), ("m/f2/a.json", '{"v": 2}'), ("m/f2/b.txt", "no"), ("n/f1/x.json", '{"v": 3}\n{"v": 4}'), ("m/f1/b.json", "torn {"), ("o/f/note.txt", "x")]):
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        os.utime(p, (1000 + at, 1000 + at))
    key = F.regexp_extract("path", r"^(\w+)/", 1)
    root = f"file://{tmp_path}/r"
    assert {(r.key, r.path) for r in files.newest(spark, root, key, ".json").collect()} == {("m", "m/f1/b.json"), ("n", "n/f1/x.json")}
    assert {(r.key, r.path) for r in files.newest(spark, root, key).collect()} == {("m", "m/f1/b.json"), ("n", "n/f1/x.json"), ("o", "o/f/note.txt")}
    os.utime(tmp_path / "r/m/f2/a.json", (3000, 3000))
    got = files.newest_rows(spark, root, key, "v int")
    for name in ("a", "b"):
        (tmp_path / f"r/m/f1/{name}.json").unlink()  # the others aren't opened
    assert {(r.key, r.v) for r in got.collect()} == {("m", 2), ("n", 3), ("n", 4)}
    with pytest.raises(AnalysisException):
        files.newest(spark, f"{root}/none", key).collect()


def test_source_text_as_expressions(spark):
    """Scrubbed text, lines, loose writes, handed names and assignments against plain Python on random code."""
    import random
    import re

    from weftline.functions import code

    rng = random.Random(13)
    parts = ["//", "/*", "*/", '"', "'", "\\", "\n", "a", "é", "𝛿", " ", "t.setAb(", ". withX (", "::setC", "x = y", "==", "r.set(c)", "r.with\n(k(", "\x01", "\x02", "/", "b", ");", "\t"]
    texts = ["", None, "\n", "s = \"// no\"; // yes \"\n/* a\nb */ t.setX(1);", "'\\''.setA(\"", "x.\nsetA(b).setB(c); y.setA(1)", "/* open", '"open \\', *("".join(rng.choices(parts, k=40)) for _ in range(300))]
    hidden = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|\'(?:\\.|[^\'\\])*(?:\'|\Z)', re.S)
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    got = {kind: sorted(map(tuple, java.scan(df, kind).collect())) for kind in code.KINDS}
    bare = {r.path: r.b for r in df.select("path", code.scrub(F.coalesce("text", F.lit(""))).alias("b")).collect()}
    want = {k: [] for k in code.KINDS}
    for k, text in enumerate(t or "" for t in texts):
        plain = hidden.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        if not re.search(r"[\"'][^\"']*\\\Z", text):  # a text that ends in a literal's backslash: both blank it or both don't
            assert bare[str(k)] == plain, text
        else:
            plain = bare[str(k)]
        line = lambda at, t=text: t.count("\n", 0, at) + 1
        want["lines"] += [(str(k), n + 1, a, b) for n, (a, b) in enumerate(zip(text.split("\n"), plain.split("\n"), strict=True))]
        want["loose_writes"] += sorted({(str(k), line(m.start()), hint, text.split("\n")[line(m.start()) - 1].strip()[:120]) for p, hint in code.LOOSE for m in re.finditer(p, plain.translate({1: " ", 2: " "}))})
        clean = text.translate({1: " ", 2: " "})
        want["injections"] += [(str(k), m[1], m[2], bool(m[3]), line(m.start())) for m in re.finditer(r"\.(\w+)\s*\(\s*(\w+)\s*(\()?", clean)]
        want["assignments"] += sorted({(str(k), m[1], line(m.start())) for m in re.finditer(r"\b(\w+)\s*=(?!=)", clean)})
    for kind in code.KINDS:
        assert got[kind] == sorted(want[kind]), kind


def test_judged_lines_are_the_source_s(spark):
    text = "one\ntwo `quoted code`\nthree"
    rows = [("a", "line 3", text), ("b", "line 4", text), ("c", "`sliced code`", text), ("d", "`sliced code\none`", text), ("e", "line 1", None), ("f", "`quoted code`", text), ("g", "`sliced code`", None)]
    made = spark.createDataFrame([(k, "fp", "x", "sliced code", t, "wrong") for k, _, t in rows], "mapper_id string, fingerprint string, field string, slice_text string, source string, user_claim string")
    said = spark.createDataFrame([(k, "fp", "x", ("true", e, "r", [])) for k, e, _ in rows], jobs.JUDGE_RESULT)
    out, rest = jobs.import_judge(made, said)
    assert {r.mapper_id: r.outcome for r in out.collect()} == dict.fromkeys("acfg", "invalid") | dict.fromkeys("bde", "unverifiable") and rest.count() == 0


def test_files_of_one_task_are_parsed_by_several(spark):
    one = spark.range(0, 900, 1, 1).select(F.col("id").alias("mapper_id"), F.concat(F.lit("M"), F.col("id").cast("string")).alias("path"), F.lit("class M { int a; void run() { Target t = new Target(); t.setA(1); } }").alias("text"), F.lit("Target").alias("target"))
    parsed = java.parse(one, ["classes", "write_sites"])
    assert parsed.select(F.spark_partition_id()).distinct().count() > 1
    rows = parsed.collect()
    assert sorted(r.mapper_id for r in rows) == list(range(900)) and all(r.path == f"M{r.mapper_id}" and [c.name for c in r.classes] == ["M"] and r.write_sites[0].target_field == "a" for r in rows)


def test_saves_of_many_documents_are_few_files(spark, tmp_path):
    side = {"method": "manual", "root": {"id": "r", "name": "r", "type": "object", "children": []}}
    doc = lambda m, at: (m, json.dumps({"version": 1, "mapperId": m, "savedAt": at, "source": side, "target": side}))
    path, df = f"file://{tmp_path}/s", lambda rows: spark.createDataFrame(rows, "mapper_id string, text string")
    schemas.save_documents(df([doc(f"m{i}", "one") for i in range(300)]), path)
    assert len(list((tmp_path / "s").rglob("*.parquet"))) <= schemas.PARTS
    schemas.save_documents(df([doc("m7", "two"), doc("m7", "too"), doc("n", "two")]), path)
    got = sorted((r.mapper_id, json.loads(r.text)["savedAt"]) for r in schemas.load_documents(spark, path).collect())
    assert got == sorted([*((f"m{i}", "one") for i in range(300) if i != 7), ("m7", "two"), ("m7", "too"), ("n", "two")])
    assert schemas.load_documents(spark, path, "m7").count() == 2 and schemas.load_documents(spark, path, "m8").count() == 1 and schemas.load_documents(spark, path, "x").count() == 0


def test_flat_schemas_hand_on_few_rows_at_once(spark, monkeypatch):
    monkeypatch.setattr(schemas, "ROWS_AT_ONCE", 10)
    docs = spark.range(0, 50, 1, 1).select("id", F.when(F.col("id") % 5 == 0, "no tag").otherwise(F.concat(F.lit("<a><b/><c/><d"), F.col("id").cast("string"), F.lit("/></a>"))).alias("x"))
    got = sorted((r.id, r.pos, r.path) for r in schemas.flat_schemas(docs, "id", "x", "payload-xml").collect())
    assert got == [(i, k, p) for i in range(50) if i % 5 for k, p in enumerate(["a", "a.b", "a.c", f"a.d{i}"])]
