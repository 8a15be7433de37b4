"""Layers of the index: what they write, what shows, and what a lost attempt leaves."""

import os
import random
import time

import pytest

R = random.Random(5)
KEYS = {"files": ["file_id", "path", "language", "sha", "mtime_ns"], "symbols": ["file_id", "name", "kind", "start_row", "end_row"], "refs": ["file_id", "name", "start_row", "start_col"]}


def shown(store):
    return {t: sorted(map(tuple, store.read(t).select(*KEYS[t]).collect())) for t in KEYS}


def test_an_update_writes_what_changed(make_index, spark, tmp_path):
    files = {f"pkg/m{i}.py": f"def f{i}(x):\n    return g{i}(x)\n" * 20 for i in range(40)}
    nav, builder, roots = make_index({"app": files})
    store, root = builder.store, roots["app"]
    base = store.manifest()

    def write(name, text):
        with open(os.path.join(root, name), "w") as f:
            f.write(text)

    write("pkg/m3.py", "def changed():\n    return 1\n")
    assert builder.update([f"{root}/pkg/m3.py"]).indexed == 1
    m = store.manifest()
    assert m.folder == base.folder and len(m.layers) == 1 and m.layers[0]["size"] < 40_000
    assert {r.name for r in store.read("symbols").where("name IN ('changed', 'f3', 'f4')").collect()} == {"changed", "f4"}
    os.remove(f"{root}/pkg/m5.py")
    write("pkg/new.py", "def fresh():\n    pass\n")
    os.utime(f"{root}/pkg/m6.py", (1, 1))
    stats = builder.update([f"{root}/pkg/m5.py", f"{root}/pkg/new.py", f"{root}/pkg/m6.py"])
    assert (stats.indexed, stats.touched) == (1, 1) and store.manifest().folder == base.folder

    # a lost attempt: the layer is there, the pointer isn't
    seen, real = shown(store), type(store)._point
    write("pkg/m7.py", "def lost():\n    pass\n")
    try:
        type(store)._point = lambda *a, **b: (_ for _ in ()).throw(OSError("lost"))
        with pytest.raises(OSError):
            builder.update([f"{root}/pkg/m7.py"])
    finally:
        type(store)._point = real
    assert shown(store) == seen
    left = store.vacuum(0)
    assert len(left) >= 1 and shown(store) == seen and not any(x.startswith(".work") for x in os.listdir(tmp_path / "index"))
    assert builder.update([f"{root}/pkg/m7.py"]).indexed == 1

    # the same as an index that is built at once
    from quarry.plans.build import Builder
    from quarry.plans.store import Store

    other = Store(spark, "file://" + str(tmp_path / "other"))
    os.makedirs(tmp_path / "other")
    Builder(spark, other, builder.config).build()
    assert shown(other) == shown(store)
    assert store.compact(whole=True).layers == [] and shown(other) == shown(store) and store.sizes()["files"] > 0
    gone = store.vacuum(0)
    assert base.folder in gone and shown(other) == shown(store)


def test_layers_merge_with_others_of_their_size(spark, tmp_path):
    from quarry.plans import store as st

    os.makedirs(tmp_path / "s")
    store, model = st.Store(spark, "file://" + str(tmp_path / "s")), {}
    kinds = {t: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x) for t, x in st.TABLES.items()}

    def tables(rows):
        from pyspark.sql import functions as F

        files = spark.createDataFrame([(i, v) for i, (v, _) in rows.items()], "file_id long, v long")
        names = spark.createDataFrame([(i, n) for i, (_, names) in rows.items() for n in names], "file_id long, n string")
        put = lambda df, t, **c: df.select(*(c[f.name].cast(f.dataType).alias(f.name) if f.name in c else F.lit(None).cast(f.dataType).alias(f.name) for f in st.TABLES[t]))
        return {"repos": spark.createDataFrame([], kinds["repos"]), "refs": spark.createDataFrame([], kinds["refs"]), "files": put(files, "files", file_id=F.col("file_id"), mtime_ns=F.col("v")), "symbols": put(names, "symbols", file_id=F.col("file_id"), name=F.col("n"))}

    def check():
        assert {r.file_id: r.mtime_ns for r in store.read("files").collect()} == {i: v for i, (v, _) in model.items()}
        assert sorted((r.file_id, r.name) for r in store.read("symbols").collect()) == sorted((i, n) for i, (_, names) in model.items() for n in names)

    model = {i: (0, [f"n{i}", "x" * 50, os.urandom(400).hex()]) for i in range(4000)}
    store.publish(tables(model))
    for step in range(1, 13):
        fresh = {R.randint(0, 4100): (step, [f"s{step}", "again"]) for _ in range(3)}
        dead = R.sample(sorted(model), 2)
        moved = [i for i in R.sample(sorted(model), 2) if i not in dead and i not in fresh]
        rows = tables(fresh)
        for i in dead:
            model.pop(i)
        model |= fresh
        for i in moved:
            model[i] = (100 + step, model[i][1])
        rows["files"] = rows["files"].unionByName(tables({i: (100 + step, []) for i in moved})["files"])
        gone = spark.createDataFrame([(i, True) for i in [*dead, *fresh]] + [(i, False) for i in moved], "file_id long, rows boolean")
        m = store.publish_delta(rows, gone)
        assert len(m.layers) <= st.MOST_LAYERS and m.folder.startswith("gen-00000001")
    check()
    assert len(store.manifest().layers) < 12
    store.compact(whole=True)
    check()
    assert not store.manifest().layers and time.time() - store.manifest().updated_at < 600
