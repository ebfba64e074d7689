from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dataward import context as auth
from dataward.context import AuthContext, run_as
from dataward.errors import BadRequestError, CheckError, ConflictError, ContextMissingError, NotFoundError, NotNullError, PluginError, PolicySchemaError, PolicyViolationError, RecordNotDeletedError, TransactionError, UniqueError
from dataward.migrations import Migration, Runner
from dataward.operators import writes
from dataward.plans import dal
from dataward.plans.transaction import transaction
from dataward.plugins import audit
from dataward.plugins.base import Plugin, find_cycle, resolve_order
from dataward.plugins.soft_delete import SoftDelete
from dataward.plugins.timestamps import Timestamps
from dataward.rls import fields, policy, relations
from dataward.rls.plugin import RowSecurity
from dataward.rls.policy import TablePolicies, allow, deny, filter_, tenant_isolation, validate
from dataward.rls.resolvers import Resolver, Resolvers
from dataward.session import Session, TableSpec
from dataward.sources import dumps
from dataward.sources.store import Store
from dataward.testing import Factory, SpyPlugin, assert_count, assert_no_row, assert_row, generated

SCHEMA = "id long, tenant_id long, owner_id long, name string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, i % 3, i % 4, f"n{i}", "draft", T0, None, T0 if i == 5 else None) for i in range(1, 11)], SCHEMA)


@pytest.fixture
def make(spark, rows):
    return lambda *plugins: Session.build(spark, [TableSpec("items", lambda _: rows, required=("name",))], plugins)


def plugin(name, priority=0, needs=(), against=()):
    return SpyPlugin(name, priority, needs, against)


def test_plugin_order():
    got = resolve_order([plugin("b"), plugin("a"), plugin("z", 10), plugin("first", -5), plugin("needs", 99, ["first"])])
    assert [p.name for p in got] == ["z", "a", "b", "first", "needs"]
    for bad in ([plugin("a"), plugin("a")], [plugin("a", needs=["x"])], [plugin("a", against=["b"]), plugin("b")], [plugin("a", needs=["b"]), plugin("b", needs=["a"])]):
        with pytest.raises(PluginError):
            resolve_order(bad)
    assert find_cycle([plugin("a", needs=["b"]), plugin("b", needs=["c"]), plugin("c", needs=["b"])]) == ["b", "c", "b"]


def test_interception_and_raw(make):
    spy = SpyPlugin()
    s = make(spy, SoftDelete())
    assert s.table("items").count() == 9 and s.raw("items").count() == 10 and s.table("items", include_deleted=True).count() == 10
    assert spy.calls[0] == ("select", "items")

    class Broken(Plugin):
        name = "broken"

        def intercept(self, df, context, session):
            raise ValueError("x")

    with pytest.raises(ValueError) as e:
        make(Broken()).table("items")
    assert "broken" in e.value.__notes__[0]
    with pytest.raises(NotFoundError):
        s.table("nope")


def test_repository_reads(make):
    r = make().repository("items")
    assert r.find_by_id(3)["name"] == "n3" and r.find_by_id(99) is None
    assert r.find_by_ids([]).count() == 0 and r.find_by_ids([1, 1, 2, 99]).count() == 2
    assert [x["id"] for x in r.find(sort=[("tenant_id", "desc")], limit=3).collect()] == [2, 5, 8]
    page, total = r.find_and_count({"tenant_id": {"$eq": 1}}, limit=2)
    assert page.count() == 2 and total == 4 and r.exists({"id": 1}) and r.count() == 10
    assert r.find(limit=0).count() == 0 and r.find({"deleted_at": None}).count() == 0 and r.find({"deleted_at": {"$eq": None}}).count() == 9
    with pytest.raises(BadRequestError):
        r.find({"nope": {"$gt": 1}})


def test_repository_writes(make):
    s = make(Timestamps(source=lambda: T1))
    r = s.repository("items")
    new = r.create({"name": "new"})
    assert new["id"] == 11 and new["created_at"] == T1 and new["updated_at"] is None
    assert r.update(11, {"name": "x"})["updated_at"] == T1 and r.find_by_id(11)["name"] == "x"
    with pytest.raises(NotFoundError):
        r.update(99, {"name": "x"})
    with pytest.raises(NotFoundError):
        r.update_many([1, 99], {"name": "lost"})
    assert_no_row(r.rows, name="lost")
    assert r.delete(11) and not r.delete(11) and r.delete_many([1, 2, 77]) == 2 and r.count() == 8
    with pytest.raises(UniqueError):
        r.create({"id": 3, "name": "twice"})
    with pytest.raises(NotNullError):
        r.create({"id": 50})
    r.checks["short"] = F.length("name") < 5
    with pytest.raises(CheckError):
        r.update(3, {"name": "far too long"})
    got = r.upsert([{"id": 3, "name": "a"}, {"id": 60, "name": "b"}, {"id": 3, "name": "c"}])
    assert {(x["id"], x["name"]) for x in got.collect()} == {(3, "c"), (60, "b")} and r.find_by_id(3)["tenant_id"] == 0
    assert r.transition({"id": 4}, "draft", "live")["status"] == "live" and r.transition({"id": 4}, "draft", "live") is None
    assert_row(r.rows, id=4, status="live")
    assert_count(r.rows, 1, status="live")


def test_soft_delete(make):
    s = make(SoftDelete(clock=lambda: T1))
    r = s.repository("items")
    assert r.soft.soft_delete(1)["deleted_at"] == T1 and r.find_by_id(1) is None and r.soft.find_with_deleted(1)["id"] == 1
    assert r.soft.find_deleted().count() == 2 and r.soft.restore(1)["deleted_at"] is None
    with pytest.raises(RecordNotDeletedError):
        r.soft.restore(1)
    with pytest.raises(NotFoundError):
        r.soft.restore(99)
    assert r.soft.soft_delete_many([2, 3, 99]).count() == 2 and r.soft.restore_many([2, 3]).count() == 2
    assert r.soft.hard_delete(1) and r.soft.find_all_with_deleted().count() == 9
    r.soft.purge()
    assert s.raw("items").count() == 8


def test_audit_trail(spark, make, rows):
    trail = audit.Audit(user=lambda: "me", clock=lambda: T1)
    r = make(trail).repository("items")
    r.create({"id": 20, "name": "new"})
    r.update(20, {"name": "newer"})
    r.delete(20)
    r.delete_many([98, 99])
    log = trail.entries.withColumn("id", F.monotonically_increasing_id())
    assert sorted(x["operation"] for x in log.collect()) == ["DELETE", "INSERT", "UPDATE"]
    update = log.filter("operation = 'UPDATE'").first()
    assert '"updated_at":null' in update["old_values"] and update["changed_by"] == "me" and update["entity_id"] == "20"
    assert audit.changed_fields(log).filter("operation = 'UPDATE'").first()["fields"] == ["name"]
    delete = log.filter("operation = 'DELETE'").first()
    back = audit.restored(rows, delete, ["id"])
    assert back.after.filter("id = 20").first()["name"] == "newer"
    undone = audit.restored(back.after, update, ["id"])
    assert undone.after.filter("id = 20").first()["name"] == "new" and undone.after.count() == 11
    with pytest.raises(audit.AuditRestoreError):
        audit.restored(rows, log.filter("operation = 'INSERT'").first(), ["id"])
    assert audit.restored(back.after, log.filter("operation = 'INSERT'").first(), ["id"], True).after.count() == 10


def test_state_fold(spark):
    entries = [(1, "INSERT", '{"a": "1"}'), (2, "UPDATE", '{"b": "2"}'), (3, "UPDATE", '{"a": null}'), (4, "DELETE", None), (5, "UPDATE", '{"c": "3"}'), (6, "UPDATE", "no json")]
    log = spark.createDataFrame([(i, "t", "1", o, None, n, None, datetime(2024, 1, i), None) for i, o, n in entries], audit.LOG_SCHEMA)
    state = lambda day: audit.state_at(log, datetime(2024, 1, day)).first()["state"]
    assert state(2) == {"a": "1", "b": "2"} and state(3) == {"b": "2", "a": None} and state(4) is None and state(5) == {"c": "3"} and state(6) == {"c": "3"}
    assert audit.find_entry(log, "3")["id"] == 3 and audit.find_entry(log, "2024-01-02T10:00:00")["id"] == 2
    row = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("x"), F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4")).alias("y"))
    got = row.select(*[c.alias(k) for k, c in audit.map_diff(F.col("x"), F.col("y")).items()]).first().asDict()
    assert got == {"added": ["c"], "removed": ["a"], "changed": ["b"], "unchanged": []}


def test_row_security(make):
    rules = {"items": TablePolicies((*tenant_isolation(), allow(["create", "update"], None), allow("delete", lambda c: F.col("owner_id") == c.user_id), deny("update", lambda c: F.col("status") == "locked")))}
    s = make(RowSecurity(rules, bypass_roles=["root"]))
    with pytest.raises(ContextMissingError):
        s.table("items")
    with run_as(AuthContext(1, ("user",), tenant_id=1)):
        r = s.repository("items")
        assert r.count() == 4
        r.update(1, {"name": "ok"})
        with pytest.raises(PolicyViolationError):
            r.update(2, {"name": "other tenant"})
        with pytest.raises(PolicyViolationError):
            r.create({"id": 70, "name": "x", "tenant_id": 2})
        with pytest.raises(PolicyViolationError):
            r.update(1, {"tenant_id": 2})
        with pytest.raises(PolicyViolationError):
            r.delete(4)
        assert r.delete(1) and r.security.without(lambda x: x.count()) == 9
        assert r.security.can_access("read", 4) and not r.security.can_access("read", 2)
    with run_as(AuthContext(1, ("user",))):
        assert s.table("items").count() == 0
    with run_as(AuthContext(1, ("root",))), auth.as_system() as c:
        assert c.is_system and s.table("items").count() == 9


def test_policy_schemas():
    base = TablePolicies((allow("all", name="a"), filter_("read", lambda c: {"x": 1}, "f")))
    assert [p.name for p in policy.override(base, a=deny("all")).policies] == ["a", "f"] and policy.override(base, a=deny("all")).policies[0].kind == "deny"
    assert len(policy.merge({"t": base}, {"t": policy.extend(TablePolicies(()), deny("delete"))})["t"].policies) == 3
    for bad in (filter_("read", None), validate("all", None), filter_("delete", lambda c: {})):
        with pytest.raises(PolicySchemaError):
            policy.check_schema({"t": TablePolicies((bad,))})
    with pytest.raises(PolicySchemaError):
        allow("drop")
    late = policy.when_hours(allow("read"), 22, 6, lambda: datetime(2024, 1, 1, 23))
    assert late.holds_for(AuthContext(1, ())) and not policy.when_hours(allow("read"), 9, 17, lambda: datetime(2024, 1, 1, 23)).holds_for(AuthContext(1, ()))
    assert policy.when_feature(allow("read"), "x").holds_for(AuthContext(1, (), attributes={"features": ["x"]}))


def test_relations_with_nulls(spark):
    main = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id long, team_id long")
    tables = {"teams": spark.createDataFrame([(10, True), (20, False)], "id long, live boolean"), "members": spark.createDataFrame([(10, 7), (10, 7), (20, 7)], "team_id long, user_id long")}
    path = relations.Path("team", (relations.Step("teams", "team_id", conditions={"live": True}), relations.Step("members", "id", "team_id")))
    assert [r["id"] for r in relations.related(main, path, tables, {"user_id": 7}).collect()] == [1]
    assert sorted(r["id"] for r in relations.related(main, path, tables, {"user_id": 7}, deny=True).collect()) == [2, 3]
    assert relations.related(main, path, tables, {"user_id": []}).count() == 0
    with pytest.raises(PolicySchemaError):
        relations.Path("x", (relations.Step("a"), relations.Step("c", from_="b")))


def test_fields(rows):
    access = fields.FieldAccess({"name": fields.masked(lambda c: F.lit("***")), "status": fields.never(), "owner_id": fields.read_only(), "tenant_id": fields.owner_only()})
    who = AuthContext(2, ("user",))
    got = fields.mask_frame(rows, access, who, exclude=["created_at"], omitted_as="omitted")
    assert "status" not in got.columns and "created_at" not in got.columns
    row = got.filter("id = 3").first()
    assert row["name"] == "***" and row["tenant_id"] is None and row["omitted"] == ["tenant_id"] and got.filter("id = 2").first()["tenant_id"] == 2
    with pytest.raises(PolicyViolationError, match="owner_id"):
        fields.check_write(rows.filter("id = 2"), {"owner_id": 1, "tenant_id": 1}, access, who)
    assert set(fields.writable_patch({"status": 1, "id": 1}, access, who)) == {"id"}
    assert fields.mask_frame(rows, fields.FieldAccess(default_allow=False), who).columns == []


def test_resolvers():
    calls = []
    r = Resolvers([Resolver("b", lambda c, f: calls.append("b") or {"x": f["a"] + 1}, ("a",)), Resolver("a", lambda c, f: calls.append("a") or {"a": 1}), Resolver("bad", lambda c, f: 1 / 0, required=False)])
    assert r.resolve(AuthContext(1, ())).attributes == {"a": 1, "x": 2}
    r.resolve(AuthContext(1, ()))
    assert calls == ["a", "b"]
    with pytest.raises(RuntimeError):
        Resolvers([Resolver("bad", lambda c, f: 1 / 0)]).resolve(AuthContext(1, ()))
    with pytest.raises(PolicySchemaError):
        Resolvers([Resolver("a", lambda c, f: {}, ("b",)), Resolver("b", lambda c, f: {}, ("a",))])


def test_store_and_transactions(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.tables() == [] and store.columns("items") == []
    store.commit({"items": rows})
    s = Session.build(spark, [TableSpec("items", lambda _: rows)])
    with transaction(s, store) as t:
        r = t.session.repository("items")
        r.delete(1)
        with pytest.raises(ValueError), t.savepoint():
            r.delete(2)
            raise ValueError
        assert r.count() == 9 and store.read("items").count() == 10
    assert store.read("items").count() == 9 and store.version() == 2 and store.read("items", 1).count() == 10
    with pytest.raises(ZeroDivisionError), transaction(s, store) as t:
        t.session.repository("items").delete(2)
        1 / 0
    assert store.version() == 2
    with pytest.raises(ConflictError), transaction(s, store) as t:
        t.session.repository("items").delete(2)
        store.commit({"other": rows.limit(1)})
    assert store.size("items") > 0 and store.statistics().filter("table_name = 'items'").first()["row_count"] == 9
    assert store.truncate("items", "nope") == {"items": True, "nope": False} and store.read("items").count() == 0
    store.drop("items")
    assert not store.exists("items")


def test_composition(make, spark, tmp_path):
    s = make()
    items = dal.query(lambda x, n=0: x.table("items").filter(F.col("id") > n))
    assert dal.compose(items, lambda c, df: df.count())(s, 4) == 6
    assert dal.chain(items, lambda c, df: df.filter("id < 8"), lambda c, df: df.count())(s, 4) == 3
    assert {k: v.count() for k, v in dal.parallel(a=items, b=items)(s, 9).items()} == {"a": 1, "b": 1}
    assert dal.conditional(lambda c, n: n > 5, items)(s, 1) is None and dal.map_result(items, lambda df: df.select("id"))(s).columns == ["id"]
    with pytest.raises(TransactionError):
        dal.transactional(lambda c: 1)(s)
    with transaction(s, Store(spark, str(tmp_path / "x"))) as t:
        assert dal.transactional(lambda c: 1)(t) == 1 and items(t).count() == 10


def test_migrations(spark, tmp_path):
    store, ran = Store(spark, str(tmp_path / "m")), []
    step = lambda n, undo=True: Migration(n, lambda s: ran.append(n), (lambda s: ran.append(f"-{n}")) if undo else None)
    runner = Runner(store, [step("002"), step("001"), step("003")], lambda: T0)
    assert runner.up(dry_run=True) == ["001", "002", "003"] and ran == []
    assert runner.up(to="001") == ["001"] and runner.up() == ["002", "003"] and runner.up() == []
    assert runner.status() == [("001", True), ("002", True), ("003", True)]
    assert runner.rollback() == ["003", "002"] and runner.down() == ["001"] and ran == ["001", "002", "003", "-003", "-002", "-001"]


def test_dumps(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "it's", True, None), (2, None, False, 1.5)], "id long, name string, ok boolean, x double")
    dumps.dump_json({"t": df}, str(tmp_path / "d"))
    back = dumps.restore_json(spark, str(tmp_path / "d"))["t"]
    assert back.schema.names == df.schema.names and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert dumps.insert_statements(df, "t").first()["statement"] == "INSERT INTO `t` (`id`, `name`, `ok`, `x`) VALUES (1, 'it''s', TRUE, NULL);"
    assert dumps.create_statement(df, "t") == "CREATE TABLE `t` (`id` BIGINT, `name` STRING, `ok` BOOLEAN, `x` DOUBLE);"
    assert list(dumps.split_statements("select ';' as a; -- x;y\nselect 2; /* ; */ select `;`")) == ["select ';' as a", "-- x;y\nselect 2", "/* ; */ select `;`"]
    dumps.save_fixture({"t": df}, str(tmp_path / "f.json"), ["a"])
    assert dumps.load_fixture(spark, str(tmp_path / "f.json"), {"t": df.schema}, ["a"])["t"].count() == 2
    assert dumps.load_fixture(spark, str(tmp_path / "f.json"), {"t": df.schema}, ["b"]) == {}


def test_factories(spark):
    f = Factory(name=lambda n: f"n{n}", ok=True)
    assert f.build_many(2, ok=False) == [{"name": "n1", "ok": False}, {"name": "n2", "ok": False}]
    schema = spark.createDataFrame([], SCHEMA).schema
    a, b = (generated(spark, schema, 50, 3, {"owner_id": 7}) for _ in range(2))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.agg(F.max("owner_id")).first()[0] <= 7


def test_write_functions(spark, rows):
    assert writes.insert(rows, rows.limit(2)).after.count() == 12 and writes.truncate(rows).after.count() == 0
    got = writes.with_ids(rows.limit(3).drop("id"), "id", 100, ["name"]).select("id").collect()
    assert sorted(r["id"] for r in got) == [101, 102, 103]
    with pytest.raises(writes.ForeignKeyError):
        writes.check_foreign_key(rows, "owner_id", spark.range(2), "id")


# Ways around the guards


def _own(s):
    rules = {"items": TablePolicies((*tenant_isolation(), allow("all", lambda c: F.col("tenant_id") == c.tenant_id), deny("delete", lambda c: F.col("status") == "kept")))}
    return s.with_plugins(RowSecurity(rules))


def test_upsert_is_judged_by_what_the_row_becomes(make):
    s = _own(make())
    r = s.repository("items")
    with run_as(AuthContext("1", ("user",), tenant_id=1)):
        with pytest.raises(PolicyViolationError):
            r.upsert([{"id": 1, "tenant_id": 2}])
        with pytest.raises(PolicyViolationError):
            r.upsert([{"id": 2, "tenant_id": 1}])
        with pytest.raises(PolicyViolationError):
            r.upsert([{"id": 77, "tenant_id": 2, "name": "new"}])
        r.upsert([{"id": 1, "tenant_id": 1, "name": "mine"}, {"id": 78, "tenant_id": 1, "name": "new"}])
        with pytest.raises(NotNullError):
            r.upsert([{"id": 79, "tenant_id": 1, "name": None}])
    assert {x["id"]: (x["tenant_id"], x["name"]) for x in s.raw("items").filter("id in (1, 2, 77, 78, 79)").collect()} == {1: (1, "mine"), 2: (2, "n2"), 78: (1, "new")}


def test_purge_is_a_delete(make):
    trail = audit.Audit()
    rules = {"items": TablePolicies((allow("delete", lambda c: F.col("tenant_id") == c.tenant_id),))}
    s = make(SoftDelete(), RowSecurity(rules), trail)
    r = s.repository("items")
    with run_as(AuthContext("1", ("user",), tenant_id=1)), pytest.raises(PolicyViolationError):
        r.soft.purge()
    assert s.raw("items").count() == 10 and trail.entries is None
    with run_as(AuthContext("1", ("user",), tenant_id=2)):
        r.soft.purge()
    assert s.raw("items").count() == 9 and [x["operation"] for x in trail.entries.collect()] == ["DELETE"]


def test_threads_keep_the_user(make):
    s = make(RowSecurity({"items": TablePolicies(tenant_isolation())}))
    count = lambda session: session.table("items").count()
    with run_as(AuthContext("1", ("user",), tenant_id=1)):
        assert dal.parallel(a=count, b=count)(s) == {"a": 4, "b": 4}
        found = Resolvers([Resolver("who", lambda c, f: {"who": auth.current().user_id})]).resolve(auth.current())
        assert found.attributes["who"] == "1"
    with pytest.raises(ContextMissingError):
        dal.parallel(a=count)(s)


def test_relations_need_a_context(make, rows):
    path = relations.membership("owner", ("owners", "owner_id", "id"))
    policy_ = relations.allow_relation(path, lambda c: {"id": c.user_id})
    for require in (True, False):
        s = make(relations.RelationSecurity({"items": [policy_]}, require_context=require))
        if require:
            with pytest.raises(ContextMissingError):
                s.table("items")
        else:
            assert s.table("items").count() == 0
        with auth.as_system():
            assert s.table("items").count() == 10
    with pytest.raises(PolicySchemaError):
        relations.Path("odd", (relations.Step("a", how="sideways"),))


def test_fields_are_guarded_in_writes(make):
    from dataward.rls.plugin import FieldSecurity

    access = fields.FieldAccess({"status": fields.owner_or_roles(["admin"], "owner_id"), "tenant_id": fields.never()})
    r = make(FieldSecurity({"items": access})).repository("items")
    with run_as(AuthContext(1, ("user",))):
        assert "tenant_id" not in r.rows.columns
        r.update(1, {"name": "x"})
        r.update(5, {"status": "y"})
        for write in (lambda: r.update(2, {"status": "y"}), lambda: r.upsert([{"id": 2, "status": "y"}]), lambda: r.update(1, {"tenant_id": 3}), lambda: r.create({"id": 90, "name": "z", "tenant_id": 3})):
            with pytest.raises(PolicyViolationError):
                write()
    with pytest.raises(ContextMissingError):
        r.update(1, {"name": "x"})
    with auth.as_system():
        r.update(1, {"tenant_id": 9})


def test_checks_without_writing(make):
    s = _own(make())
    r = s.repository("items")
    with run_as(AuthContext("1", ("user",), tenant_id=1)):
        r.security.check_update(1, {"name": "x"})
        r.security.check_create([{"id": 50, "tenant_id": 1, "name": "x"}])
        r.security.check_delete(1)
        for check in (lambda: r.security.check_update(2, {"name": "x"}), lambda: r.security.check_update(1, {"tenant_id": 2}), lambda: r.security.check_create([{"tenant_id": 2}]), lambda: r.security.check_delete(2)):
            with pytest.raises(PolicyViolationError):
                check()
        assert r.security.check_read(1) and not r.security.check_read(2)
        assert r.security.can_mutate("update", 1, {"name": "x"}) and not r.security.can_mutate("delete", 2) and r.security.can_mutate("create", values={"tenant_id": 1})
    assert s.raw("items").filter("name = 'x'").count() == 0


def test_stored_log_goes_on(make, spark):
    kept = []
    first = audit.Audit(sink=kept.append, metadata=lambda: {"request": 5})
    r = make(first).repository("items")
    r.update_many([1, 2, 3], {"name": "x"})
    again = audit.Audit(sink=kept.append, log=lambda: kept[0])
    make(again).repository("items").delete(4)
    log = kept[0].unionByName(kept[1])
    assert log.columns == list(audit.COLUMNS) and log.select("id").distinct().count() == 4
    assert kept[1].first()["id"] > kept[0].agg(F.max("id")).first()[0] and kept[0].first()["metadata"] == '{"request": 5}'
    assert [h["operation"] for h in audit.history(log, "items", 4).collect()] == ["DELETE"]
    assert audit.find_entry(log, str(kept[1].first()["id"]))["operation"] == "DELETE"


def test_add_or_insert(make):
    s = make()
    got = s.repository("items").add_or_insert([{"id": 1, "owner_id": 5, "name": "no"}, {"id": 1, "owner_id": 2, "name": "no"}, {"id": 40, "owner_id": 3, "name": "new"}], ["owner_id"])
    assert {(r["id"], r["owner_id"], r["name"]) for r in got.collect()} == {(1, 8, "n1"), (40, 3, "new")} and s.raw("items").count() == 11


def test_upserts_of_upserts_can_be_joined(spark, tmp_path):
    """Whatever Spark makes of the joins at run time, and however many parts the batches have."""
    spark.createDataFrame([(i, i % 5, 0.0) for i in range(2000)], "id long, tenant int, x double").write.parquet(str(tmp_path / "t"))
    got, rows = spark.read.parquet(str(tmp_path / "t")), []
    for k in range(3):
        rows.append((k * 1500, 3, float(k)))
        got = writes.upsert(got, spark.createDataFrame(spark.sparkContext.parallelize(rows[-1:], 8), got.schema), ["id"]).after
    batch = spark.createDataFrame(spark.sparkContext.parallelize([(0, 3, 9.0), (1, None, 1.0), (7000, 1, 2.0)], 8), got.schema)
    known = got.join(batch.select("id"), "id", "left_semi")
    assert sorted(r["id"] for r in batch.join(known.select("id"), "id", "left_anti").collect()) == [7000]
    change = writes.upsert(got, batch, ["id"], ["x"])
    assert sorted(map(tuple, change.affected.collect())) == [(0, 3, 9.0), (1, 1, 1.0), (7000, 1, 2.0)]
    assert change.after.count() == 2002 and change.after.where("x > 0").count() == 5


def test_store_commits_schemas_and_locks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"a": spark.range(3), "b": spark.range(2)})
    with pytest.raises(ConflictError):
        store.commit({"a": spark.range(9)}, base=0)
    assert store.version() == 1 and store.read("a").count() == 3
    assert [tuple(r)[:2] for r in store.statistics().orderBy("table_name").collect()] == [("a", 3), ("b", 2)] and tuple(store.info().first())[:2] == (2, 5)
    store.create_schema("tenant_1").commit({"x": spark.range(1)})
    assert store.schema_names() == ["tenant_1"] and store.schema("tenant_1").tables() == ["x"]
    for wrong in (lambda: store.create_schema("tenant_1"), lambda: store.drop_schema("tenant_1")):
        with pytest.raises(ConflictError):
            wrong()
    with pytest.raises(BadRequestError):
        store.create_schema("../x")
    store.drop_schema("tenant_1", cascade=True)
    with pytest.raises(NotFoundError):
        store.schema("tenant_1")
    with store.lock(), pytest.raises(ConflictError), store.lock():
        pass
    with store.lock():
        pass
    runner = Runner(store, [Migration("1", lambda st: st.commit({"c": spark.range(1)}))])
    assert runner.locked_up() == ["1"] and store.exists("c")


def test_identifiers_and_dumps(spark, tmp_path):
    from dataward.functions import text

    assert text.quoted("a`b") == "`a``b`" and text.qualified("s", None, "t") == "`s`.`t`"
    for bad in ("", "1a", "a-b", "x" * 129, "a\n"):
        with pytest.raises(BadRequestError):
            text.check_identifier(bad)
    odd = spark.createDataFrame([(1, "x")], "`a``b` int, c string")
    assert dumps.create_statement(odd, "t`t").startswith("CREATE TABLE `t``t` (`a``b` INT") and "`a``b`" in dumps.insert_statements(odd, "t").first()[0]
    dumps.dump_sql({"t": odd}, str(tmp_path / "d"), drop=True)
    lines = [r["value"] for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "d")).collect()]
    assert sum(x.startswith(("DROP", "CREATE", "INSERT")) for x in lines) == 3
    row = spark.createDataFrame([("SELECT a FROM t WHERE x IN (SELECT y FROM u) ORDER BY z",)], "q string")
    got = row.select(text.formatted_sql(F.col("q")).alias("f"), text.pretty_sql(F.col("q")).alias("p"), text.minified_sql(F.lit(" a ,b\n( c )  d ")).alias("m")).first()
    assert got["f"] == "SELECT a\nFROM t\nWHERE x IN (SELECT y\nFROM u)\nORDER BY z" and got["m"] == "a, b (c) d"
    assert got["p"] == "SELECT a\nFROM t\nWHERE x IN (\n  SELECT y\nFROM u\n)\nORDER BY z"


def test_validation_modes(spark, monkeypatch):
    from dataward.plans import validation

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    for environment, variable, want in (("development", None, True), ("production", None, False), ("development", "never", False), (None, "always", True)):
        for name, value in ((validation.ENVIRONMENT, environment), (validation.VARIABLE, variable)):
            monkeypatch.setenv(name, value) if value else monkeypatch.delenv(name, raising=False)
        assert validation.should_validate() is want
    with pytest.raises(NotNullError):
        validation.validated(df, ["name"], chosen="always")
    good, bad = validation.valid_rows(df, ["name"], {"small": F.col("id") < 5})
    assert good.count() == 1 and bad.first()["violations"] == ["required:name"]
    with pytest.raises(BadRequestError):
        validation.should_validate("sometimes")


def test_decisions_note_the_context(spark):
    from dataward.rls.decisions import DecisionLog

    seen = []
    log = DecisionLog(spark, seen.append, interval=0.0, include=("tenant_id", "roles"), exclude=("roles",))
    with run_as(AuthContext("1", ("user",), tenant_id=4)):
        log({"table": "t", "operation": "read", "decision": "deny"})
    assert seen[0].first()["context"] == '{"tenant_id": 4}' and not log.waiting


def test_months_run_over():
    from dataward.functions.stats import since

    assert since("1m", datetime(2024, 3, 31), True) == datetime(2024, 3, 2) and since("1m", datetime(2024, 3, 31)) == datetime(2024, 2, 29)
    assert since("13m", datetime(2024, 3, 1)) == datetime(2023, 2, 1) == since("13m", datetime(2024, 3, 1), True)
