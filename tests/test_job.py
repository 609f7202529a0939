import json
import struct

import numpy as np
import pytest

from chronoplane.analysis import attribution as att
from chronoplane.analysis import reports
from chronoplane.analysis.bottlenecks import bottlenecks, report
from chronoplane.analysis.nnls import nnls
from chronoplane.model.execution import ExecutionModel, ModelError
from chronoplane.plans.session import Session
from chronoplane.sources.hosts import parse_hosts
from chronoplane.sources.job import read_job
from chronoplane.sources.monitor import decode_cpu, decode_disk, decode_network
from chronoplane.sources.spark_log import infer_dependencies
from chronoplane.sources.workflow_logs import parse_dag

T0 = 1_600_000_000_000  # ms
APP = "app-20200913-0001"


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def cpu_file(times, busy, cores=2):
    out = b""
    for t, b in zip(times, busy, strict=True):
        out += struct.pack("<q", t) + varint(cores)
        for _ in range(cores):
            out += b"".join(varint(x) for x in [int(1000 * b), 0, 0, 1000 - int(1000 * b), 0, 0, 0, 0, 0, 0])
    return out


def listed_file(times, names, counters):
    out = struct.pack("<q", times[0]) + b"\0" + varint(len(names)) + b"".join(n.encode() + b"\0" for n in names)
    for t in times[1:]:
        out += struct.pack("<q", t) + b"\1" + varint(len(names)) + b"".join(varint(x) for _ in names for x in counters)
    return out


def event(kind, **fields):
    return json.dumps({"Event": f"SparkListener{kind}"} | {k.replace("_", " "): v for k, v in fields.items()})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    (root / "hosts").write_text("# machines\nnode1 node1.local 10.0.0.1\nnode2\tnode2.local\n\n")
    logs, air, mon = root / "logs/spark", root / "logs/airflow", root / "metrics/resource-monitor/run"
    for d in (logs, air / "t", mon):
        d.mkdir(parents=True)
    lines = [
        event("ApplicationStart", App_ID=APP, Timestamp=T0),
        event("BlockManagerAdded", Block_Manager_ID={"Executor ID": "driver", "Host": "node1.local"}, Timestamp=T0),
        event("BlockManagerAdded", Block_Manager_ID={"Executor ID": "1", "Host": "node2"}, Timestamp=T0),
    ]
    for job, (start, end) in enumerate([(1000, 4000), (4000, 9000)]):
        lines.append(event("JobStart", Job_ID=job, Stage_IDs=[job], Submission_Time=T0 + start))
        info = {"Stage ID": job, "Stage Attempt ID": 0, "Submission Time": T0 + start, "Completion Time": T0 + end}
        lines.append(event("StageSubmitted", Stage_Info=info))
        for task, host in enumerate(("node1", "node2.local")):
            info_t = {"Task ID": 10 * job + task, "Attempt": 0, "Launch Time": T0 + start, "Finish Time": T0 + end - 500 * task, "Host": host}
            lines.append(event("TaskStart", Stage_ID=job, Stage_Attempt_ID=0, Task_Info=info_t))
            lines.append(event("TaskEnd", Stage_ID=job, Stage_Attempt_ID=0, Task_Info=info_t))
        lines.append(event("StageCompleted", Stage_Info=info))
        lines.append(event("JobEnd", Job_ID=job, Completion_Time=T0 + end))
    lines.append(event("ApplicationEnd", Timestamp=T0 + 10_000))
    (logs / "events").write_text("\n".join(lines) + "\n\n")
    (logs / "other.txt").write_text("not a log\n")
    (air / "etl.dag").write_text("<Task(A): extract>\n    <Task(B): train>\n        <Task(B): report>\n    <Task(C): report>\n")
    (air / "etl.run_ids").write_text("run1\n\n")
    head = lambda task: f"AIRFLOW_CTX_DAG_ID=etl\nAIRFLOW_CTX_DAG_RUN_ID=run1\nAIRFLOW_CTX_TASK_ID={task}\n"
    at = lambda s: f"[2020-09-13 12:26:{40 + s // 1000:02d},{s % 1000:03d}] {{x.py:1}} INFO - "
    (air / "t/1.log").write_text(head("extract") + at(0) + "Executing <Task(A): extract>\n" + at(10) + f"Spark started {APP}\n" + at(10_000) + "Marking task as SUCCESS\n")
    (air / "t/2.log").write_text(head("train") + at(10_000) + "Executing <Task(B): train>\n2020 I tensorflow/core\n" + at(11_000) + "[1,0]<stdout>:Epoch 1/2\n" + at(12_000) + "\n" + at(12_500) + "[1,0]<stdout>:Epoch 2/2\n" + at(14_000) + "x\n" + at(15_000) + "Marking task as SUCCESS\n")
    ns = lambda ms: (T0 + ms) * 1_000_000
    for host, level in (("node1", 0.5), ("node2", 0.99)):
        (mon / f"proc-stat-{host}").write_bytes(cpu_file([ns(x) for x in range(0, 6000, 1000)], [level] * 6) + b"\1\2")
        (mon / f"proc-net-dev-{host}").write_bytes(listed_file([ns(0), ns(1000), ns(3000)], ["eth0"], [1000, 1, 4000, 2]))
        (mon / f"proc-diskstats-{host}").write_bytes(listed_file([ns(0), ns(2000)], ["sda", "sdb"], [1, 8, 500, 1, 16, 250, 5000]))
    (mon / "later").mkdir()
    (mon / "later/proc-stat-node1").write_bytes(cpu_file([ns(7000), ns(8000)], [0.0, 0.25]))
    return str(root)


@pytest.fixture(scope="module")
def job(spark, folder):
    return read_job(spark, folder)


def test_tree(job):
    phases = {r.path: r for r in job.phases.collect()}
    app = f"/etl[run_id=run1]/extract/SparkApplication[app={APP}, id=1]"
    assert set(phases) == {
        "/", "/etl[run_id=run1]", "/etl[run_id=run1]/extract", "/etl[run_id=run1]/train", "/etl[run_id=run1]/train/TensorFlowJob", *(f"/etl[run_id=run1]/train/TensorFlowJob/Epoch[id={n}]" for n in (1, 2)),
        app, f"{app}/Driver", *(f"{app}/Stage[attempt=0, id={j}]" for j in (0, 1)), *(f"{app}/Stage[attempt=0, id={j}]/Task[attempt=0, id={10 * j + t}]" for j in (0, 1) for t in (0, 1)),
    }
    task = phases[f"{app}/Stage[attempt=0, id=1]/Task[attempt=0, id=11]"]
    assert task.type == "/etl/extract/SparkApplication[id=1]/Stage[id=1]/Task" and task.machine == "node2.local" and task.is_leaf and task.end_ns == (T0 + 8500) * 1_000_000
    assert not phases[f"{app}/Stage[attempt=0, id=1]"].is_leaf and phases[f"{app}/Driver"].is_leaf and phases["/"].end_ns == (T0 + 15_000) * 1_000_000
    flows = {(r.source.rpartition("/")[2], r.sink.rpartition("/")[2]) for r in job.model.flow_frame(job.spark).collect()}
    assert flows == {("extract", "train"), ("Epoch[id=1]", "Epoch[id=2]"), ("Stage[attempt=0, id=0]", "Stage[attempt=0, id=1]")}
    assert job.aliases["10.0.0.1"] == "node1"


def test_metrics(job):
    rows = {}
    for r in job.metrics.collect():
        rows.setdefault(r.metric_path, []).append((r.start_ns // 1_000_000 - T0, r.end_ns // 1_000_000 - T0, r.value, r.max_value))
    cpu = sorted(rows["/cluster/machine[hostname=node1]/cpu:utilization"])
    assert cpu == [(i, i + 1000, 1.0, 2.0) for i in range(0, 5000, 1000)] + [(5000, 7000, 0.0, 2.0), (7000, 8000, 0.5, 2.0)]
    assert sorted(rows["/cluster/machine[hostname=node2]/cpu:cores-fully-utilized"])[0] == (0, 1000, 2.0, 2.0)
    assert rows["/cluster/machine[hostname=node2]/cpu/core[id=1]:utilization"][0][3] == 1.0
    assert sorted(rows["/cluster/machine[hostname=node1]/network[iface=eth0]:bytes-sent"]) == [(0, 1000, 4000.0, 1e9), (1000, 3000, 2000.0, 1e9)]
    disk = "/cluster/machine[hostname=node1]/disk[device=sdb]:"
    assert [rows[disk + m][0][2] for m in ("bytes-read", "bytes-written", "read-time", "write-time", "total-utilization")] == [2048.0, 4096.0, 0.25, 0.125, 1.0]


def test_decoders_stop_at_broken_messages():
    assert list(decode_cpu(b"")) == [] and list(decode_network(b"\0" * 9)) == [] and list(decode_disk(struct.pack("<q", 1) + b"\0" + varint(1) + b"sda\0" + struct.pack("<q", 2) + b"\1")) == []
    with pytest.raises(ValueError):
        list(decode_network(struct.pack("<q", 1) + b"\1"))


def test_dependencies_against_their_rule():
    """A job needs those that ended by its start, unless one of these needs them."""
    rnd = np.random.default_rng(7)
    for _ in range(200):
        jobs = {i: (int(s), int(s + d)) for i, (s, d) in enumerate(zip(rnd.integers(0, 30, 12), rnd.integers(1, 12, 12)))}
        needs = infer_dependencies(jobs)
        for j, (start, _) in jobs.items():
            ended = {i for i, (_, end) in jobs.items() if end <= start}
            assert needs.get(j, set()) == ended - {i for k in ended for i in needs.get(k, ())}


def test_samples_at_one_time_have_no_rates():
    rows = list(decode_network(listed_file([0, 1000, 1000, 3000], ["eth0"], [1000, 1, 4000, 2])))
    assert [r[2:4] for r in rows] == [(0, 1000), (0, 1000), (1000, 3000), (1000, 3000)]
    assert [r[2:4] for r in decode_cpu(cpu_file([5, 5, 9], [0.5] * 3))] == [(5, 9)] * 4
    assert len(list(decode_disk(listed_file([0, 0], ["sda"], [1] * 7)))) == 0


def test_phase_conditions_reach_attribution(spark, job):
    s = Session(spark)
    s.register_job(job)
    from_all = 'FROM attributed_metrics WHERE metric_path ~= "/cluster/machine[hostname=node2]/cpu:utilization"'
    plain = {tuple(r) for r in s.sql(f"{from_all} SELECT *;").collect()}
    for condition in ('phase_path ~= "**Task*"', 'phase_type = "/etl" OR phase_path = "/"', 'phase_path ~= "/etl*/extract/*"', 'phase_path = "/none"'):
        one = {tuple(r) for r in s.sql(f"{from_all} AND ({condition}) SELECT *;").collect()}
        assert one == {tuple(r) for r in s.sql(f"FROM ({from_all} SELECT *) WHERE {condition} SELECT *;").collect()} and one <= plain
    pairs = lambda only: att.Attribution(job.metrics, job.phases, job.aliases).only(phases=only).attributed().select("phase_path").distinct().count()
    from pyspark.sql import functions as F

    assert pairs(F.col("phase_path") == "/") == 1


def test_saved_rules_are_used(spark, job, tmp_path):
    a = att.Attribution(job.metrics, job.phases, job.aliases)
    a.save_rules(f"file://{tmp_path}/rules")
    s = Session(spark)
    s.register_job(job, rules=spark.read.parquet(f"file://{tmp_path}/rules"))
    query = 'FROM attributed_metrics WHERE metric_path ~= "**node1]/cpu:utilization" SELECT *;'
    t = Session(spark)
    t.register_job(job)
    assert sorted(map(str, s.sql(query).collect())) == sorted(map(str, t.sql(query).collect()))


def test_session_over_job(spark, job):
    s = Session(spark)
    s.register_job(job)
    assert s.sql("FROM phases SELECT *;").count() == 15
    assert s.sql('FROM metrics WHERE path ~= "**cpu:utilization" GROUP BY path SELECT path, AVG_OVER_TIME(utilization) AS u;').filter("u > 0.9").count() == 1
    rows = s.sql('FROM attributed_metrics WHERE metric_path ~= "/cluster/machine[hostname=node2]/cpu:utilization" SELECT *;').collect()
    assert {r.phase_path.rpartition("/")[2] for r in rows} >= {"Task[attempt=0, id=1]", "Stage[attempt=0, id=0]"}
    assert not any("id=10]" in r.phase_path or "Driver" in r.phase_path for r in rows)


def leaf_usage(rows):
    return sum((r.end_ns - r.start_ns) * r.usage for r in rows)


def test_attribution_conserves_usage(job):
    a = att.Attribution(job.metrics.filter("metric_path like '%node1]/cpu:utilization'"), job.phases, job.aliases)
    rules = a.rules().collect()
    assert {r.kind for r in rules} == {att.VARIABLE} and all(r.demand >= 0 for r in rules)
    leaves = {r.path for r in job.phases.filter("is_leaf").collect()}
    out = a.attributed().collect()
    up = a.upsampled().collect()
    # Upsampling keeps every period's total.
    assert sum((r.end_ns - r.start_ns) * r.value for r in up) == pytest.approx(5.5e9)
    used = leaf_usage([r for r in out if r.phase_path in leaves])
    assert 0 < used <= 5.5e9 * (1 + 1e-9)
    root = [r for r in out if r.phase_path == "/"]
    assert leaf_usage(root) == pytest.approx(used)
    # The root's rows reach to its end, 0 where no leaf is active.
    assert min(r.start_ns for r in root) == job.start_ns and max(r.end_ns for r in root) == job.model.root.end_ns


def test_exact_overrides(spark):
    metrics = spark.createDataFrame([("m:x", "m:x", None, 0, 100, 5.0, 10.0), ("m:x", "m:x", None, 100, 200, 2.0, 10.0)], "metric_path string, metric_type string, machine string, start_ns long, end_ns long, value double, max_value double")
    phases = spark.createDataFrame([("/", None, "/", 0, 200, False, None), ("/a", "/", "/a", 0, 150, True, None), ("/b", "/", "/b", 50, 200, True, None), ("/c", "/", "/c", 0, 0, True, None)], "path string, parent string, type string, start_ns long, end_ns long, is_leaf boolean, machine string")
    overrides = spark.createDataFrame([("m:x", "/a", att.EXACT, 4.0)], att.OVERRIDES)
    a = att.Attribution(metrics, phases, overrides=overrides)
    rules = {r.phase_path: (r.kind, r.demand) for r in a.rules().collect()}
    assert rules["/a"] == (att.EXACT, 4.0) and rules["/b"][0] == att.VARIABLE
    # Least squares of b's activity (.5, 1) to what a's demand leaves: (1, 0).
    assert rules["/b"][1] == pytest.approx(0.5 / 1.25)
    up = {(r.start_ns, r.end_ns): r.value for r in a.upsampled().collect()}
    assert up == {(0, 50): 4.0, (50, 100): 6.0, (100, 150): 4.0, (150, 200): 0.0}
    got = {(r.phase_path, r.start_ns): r.usage for r in a.attributed().collect()}
    assert got[("/a", 0)] == 4.0 and got[("/b", 50)] == 2.0 and got[("/", 0)] == 4.0 and got[("/", 50)] == 6.0


def test_upsampling_gives_out_in_proportion(spark):
    """Of every period: nothing lost, no part beyond the limit, and in each of the three rounds equal levels below the caps."""
    rnd = np.random.default_rng(5)
    most, metrics, demands = 10.0, [], {"exact": [], "variable": []}
    for p in range(300):
        cuts = sorted({0, 100, *rnd.integers(1, 100, rnd.integers(0, 6)).tolist()})
        metrics.append(("m", 100 * p, 100 * p + 100, rnd.uniform(0, 10) if p % 7 else float(p % 2) * 10, most))
        for a, b in zip(cuts, cuts[1:]):
            demands["exact"].append(("m", 100 * p + a, 100 * p + b, float(rnd.choice([0, 1, 2, 5.5, 12]))))
            demands["variable"].append(("m", 100 * p + a, 100 * p + b, float(rnd.choice([0, 1, 3]))))
    table = lambda rows, last: spark.createDataFrame(rows, f"metric_path string, start_ns long, end_ns long, {last}")
    out = att.upsample(table(metrics, "value double, max_value double"), *(table(demands[k], "demand double") for k in ("exact", "variable")), merge=False).collect()
    of = {(k, s): d for k, rows in demands.items() for _, s, e, d in rows for s in range(s, e)}
    for _, start, end, value, _ in metrics:
        parts = [(r.end_ns - r.start_ns, r.value, of["exact", r.start_ns], of["variable", r.start_ns]) for r in out if start <= r.start_ns < end]
        assert sum(n for n, *_ in parts) == 100 and sum(n * x for n, x, *_ in parts) / 100 == pytest.approx(value)
        assert all(-1e-9 <= x <= most + 1e-9 for _, x, *_ in parts)
        if len({(x, v) for *_, x, v in parts}) == 1:
            continue
        first = [min(e, most) for *_, e, _ in parts]
        wanted = sum(n * f for (n, *_), f in zip(parts, first)) / 100
        close = lambda xs: max(xs) - min(xs) < 1e-6
        if value <= wanted:  # exact demand takes all: equal shares of it below the limit
            assert close([x / e for _, x, e, _ in parts if e and x < min(e, most) - 1e-9] or [0]) and all(x < 1e-9 for _, x, e, _ in parts if not e)
            continue
        over = [(x - f, v, x) for (_, x, _, v), f in zip(parts, first)]
        assert all(o >= -1e-9 for o, *_ in over)
        if any(o > 1e-9 and not v for o, v, _ in over):  # the variable demand is full, the rest is even
            assert all(x >= most - 1e-9 for _, v, x in over if v) and close([o for o, v, x in over if not v and x < most - 1e-9] or [0])
        else:
            assert close([o / v for o, v, x in over if v and x < most - 1e-9] or [0])


def test_nnls_is_optimal():
    rnd = np.random.default_rng(6)
    for _ in range(60):
        a, y = rnd.normal(size=(20, 5)), rnd.normal(size=20)
        x = nnls(a, y)
        slope = a.T @ (y - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-7 and np.abs(slope[x > 0]).max(initial=0) < 1e-7
    assert (nnls(np.full((3, 2), np.nan), np.ones(3)) == 0).all()


def test_bottlenecks(spark):
    rows = [("m1:a", "/p", 0, 100, 5.0, 10.0), ("m2:a", "/p", 0, 50, 10.0, 10.0), ("m2:a", "/p", 50, 100, 0.0, 10.0), ("m1:b", "/p", 0, 100, 3.0, 0.0)]
    used = spark.createDataFrame(rows, "metric_path string, phase_path string, start_ns long, end_ns long, usage double, capacity double")
    got = {r.group: r for r in bottlenecks(used).collect()}
    assert got["m1:a"].duration_without_overhead == 100 and got["m1:a"].duration_without_group == 100
    # b always counts as full: with m2 full in the first half nothing is gained there, in the second half what m1:a leaves.
    assert got["m1:b"].duration_without_group == 100 - 50 * 0.5 and got["m2:a"].duration_without_group == 100
    by_resource = {r.group: r.duration_without_group for r in bottlenecks(used, "resource").collect()}
    assert by_resource == {"m1": 100 - 50 * 1.0, "m2": 100.0}
    phases = spark.createDataFrame([("/p", 0, 100)], "path string, start_ns long, end_ns long")
    assert [(r.group, r.percent_of_observed) for r in report(bottlenecks(used, "resource"), phases).collect()] == [("m1", 50.0), ("m2", 0.0)]


def test_reports(job):
    phases = reports.phase_list(job.phases).collect()
    assert phases[0]["phase.path"] == "/" and phases[0]["phase.id"] == "p00" and len({r["phase.id"] for r in phases}) == 15
    types = {r["phase.type.path"]: r for r in reports.phase_type_list(job.phases).collect()}
    assert types["/etl/train"]["parent.phase.type.id"] == types["/etl"]["phase.type.id"] and types["/"]["parent.phase.type.id"] == ""
    assert reports.metric_list(job.metrics).count() == job.metrics.select("metric_path").distinct().count()
    data = reports.metric_data(job.metrics.filter("metric_path like '%node1]/cpu:utilization'")).collect()
    assert [r.value for r in sorted(data, key=lambda r: r.timestamp)] == [1.0, 0.0, 0.5, 0.5]
    paths = [r["phase.path"] for r in phases]
    assert reports.filtered_phases(paths, include=["/etl/train"]) == ["/", "/etl[run_id=run1]", "/etl[run_id=run1]/train"]
    assert len(reports.filtered_phases(paths, exclude=["/etl/extract"])) == 6
    assert reports.tree_text(paths, depth=2, short=True).splitlines() == ["/", "  etl[run_id=run1]", "    extract", "    train"]
    assert reports.active_phases(job.phases, "/etl/train/TensorFlowJob/Epoch").count() == 3


def test_report_files(job, tmp_path):
    metrics = job.metrics.filter("metric_path like '%node1]/cpu:utilization'")
    a = att.Attribution(metrics, job.phases, job.aliases)
    attributed = a.attributed()
    assert len(reports.write_tables(tmp_path / "out", metrics, job.phases, a.upsampled(), attributed)) == 7
    read = lambda name: [line.split("\t") for line in (tmp_path / "out" / name).read_text().splitlines()]
    header, *rows = read("aggregate-resource-attribution-data.tsv")
    assert header == ["metric.id", "phase.type.id", "timestamp", "value", "count"] and {r[0] for r in rows} == {"m0"}
    types = {r[1]: r[0] for r in read("phase-type-list.tsv")[1:]}
    of_tasks = sorted((int(r[2]), float(r[3]), int(r[4])) for r in rows if r[1] == types["/etl/extract/SparkApplication[id=1]/Stage[id=1]/Task"])
    own = sorted((r.start_ns, r.end_ns, r.usage) for r in attributed.filter("phase_path like '%Stage[attempt=0, id=1]/Task[attempt=0, id=10]'").collect())
    assert own and of_tasks[0] == (own[0][0], pytest.approx(own[0][2]), 1) and of_tasks[-1][0] == own[-1][1]
    assert [r[0] for r in read("phase-list.tsv")[1:]] == [f"p{i:02d}" for i in range(15)]
    names = [r[0] for r in job.metrics.select("metric_path").distinct().collect()]
    resources = reports.resources_of(job.metrics)
    kept = reports.filtered_resources(resources, include=["/cluster/machine[hostname=node1]/cpu"], exclude=["/**/core"])
    assert kept == ["/", "/cluster", "/cluster/machine[hostname=node1]", "/cluster/machine[hostname=node1]/cpu"]
    assert reports.resource_tree_text(names, kept).splitlines() == ["/", "  cluster", "    machine[hostname=node1]", "      cpu", "        :cores-fully-utilized", "        :utilization"]


def test_models_refuse_bad_changes():
    m = ExecutionModel()
    a = m.add_phase("a", 0, 1)
    b, c = m.add_phase("b", 0, 1, parent=a), m.add_phase("c", 0, 1, parent=a)
    m.add_flow(b, c)
    for bad in (lambda: m.add_flow(c, b), lambda: m.add_flow(a, b), lambda: m.add_flow(b, b), lambda: m.set_parent(a, b), lambda: m.set_parent(b, m.root), lambda: m.add_phase("d", 0, 1, {"x": "1"}, {"y"})):
        with pytest.raises(ModelError):
            bad()


def test_small_parsers(spark, tmp_path):
    assert parse_hosts(["a b\n# c\n", "a c\n"]) == {"a": {"a", "b", "c"}}
    with pytest.raises(ValueError):
        parse_hosts(["a b\nc b\n"])
    assert infer_dependencies({0: (0, 5), 1: (0, 6), 2: (6, 9), 3: (10, 11)}) == {2: {0, 1}, 3: {2}}
    assert infer_dependencies({0: (0, 5), 1: (5, 5), 2: (5, 9), 3: (9, 9)}) == {1: {0}, 2: {0}, 3: {1, 2}}
    assert parse_dag("<T(A): a>\n  <T(B): b>\n    <T(C): c>\n\n   <T(D): d>\n  <T(D): d>\n<T(C): c>\n") == (["a", "b", "c", "d"], {("a", "b"), ("b", "c"), ("b", "d"), ("a", "d")})
    empty = read_job(spark, str(tmp_path))
    assert empty.phases.count() == 1 and empty.metrics.count() == 0 and empty.metric_table().count() == 0
