"""Members of JSON texts read by ranges of any size."""

import json
import random

import pytest

from plumbline.sources import splitjson


def text(r):
    return "".join(r.choice('ab"\\{}[],: é\n ') for _ in range(r.randint(0, 12)))


def value(r, depth=0):
    kind = r.randrange(6 if depth < 3 else 3)
    if kind > 3:
        return {text(r): value(r, depth + 1) for _ in range(r.randint(0, 4))}
    if kind == 3:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return [text(r), r.randint(-9, 99), None][kind]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_members_do_not_depend_on_ranges(spark, tmp_path, size):
    r = random.Random(5)
    texts = [{"meta": {"files": {"no": 1}, text(r): value(r)}, "files": {f"{k}{text(r)}": value(r) for k in range(12)}, "z": [{"files": {"no": 2}}, "\\"], "n": 1} for _ in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(texts[0], indent=1))
    (tmp_path / "b.json").write_text(json.dumps(texts[1], ensure_ascii=False) + "\n" + json.dumps(texts[2], separators=(",", ":")))
    (tmp_path / "c.json").write_text('{"files": {}}')
    path = f"file://{tmp_path}"
    got = splitjson.json_members(spark, path, "files", size).collect()
    shown = lambda pairs: sorted((k, json.dumps(v, sort_keys=True)) for k, v in pairs)
    assert shown((x.key, json.loads(x.value)) for x in got) == shown(kv for t in texts for kv in t["files"].items())
    got = splitjson.json_members(spark, f"{path}/a.json", None, size).collect()
    assert shown((x.key, json.loads(x.value)) for x in got) == shown(texts[0].items())


def test_no_files_and_texts_that_end_early(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": [1, 2')
    got = splitjson.json_members(spark, f"file://{tmp_path}/a.json", None, 4).collect()
    assert [tuple(x) for x in got] == [("a", "1")]
    (tmp_path / "empty").mkdir()
    assert splitjson.json_members(spark, f"file://{tmp_path}/empty", None).count() == 0


def test_small_ranges_share_tasks(spark, tmp_path):
    import json

    from plumbline.sources import splitjson

    (tmp_path / "r.json").write_text(json.dumps({"files": {f"f{k}": {"n": k} for k in range(500)}}))
    found = splitjson.json_members(spark, f"file://{tmp_path}", "files", 32)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.key, r.value) for r in found.collect()) == sorted((f"f{k}", json.dumps({"n": k})) for k in range(500))
    assert splitjson._tasks(spark, [("p", 0, 1 << 16)] * (1 << 20)) == 1 << 12  # 64 GB: one for each 16 MB
