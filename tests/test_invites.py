"""Invites that a batch wants for one address, and the query against its SQL where there are such."""

from tessera import catalogue
from tessera.operators import writers
from tests.compare import check

WANTED = [(11, 1, "A@x.org"), (10, 1, " a@x.org"), (12, 2, "a@x.org"), (13, 3, "b@x.org"), (14, 3, "b@x.org")]


def test_query_has_the_rows_of_its_sql_where_addresses_are_wanted_twice(spark):
    check(catalogue.QUERIES["invite_create"], catalogue.ORACLES["invite_create"], spark, "/root/testdata/sf0.01")


def test_wanted_alone_and_together(spark):
    old = spark.createDataFrame([(1, 3, "B@x.org", "pending")], "invite_id long, project_id long, email string, status string").selectExpr("*", "timestamp '2024-03-01 00:00:00' as expires_at")
    wanted = spark.createDataFrame(WANTED, "invite_id long, project_id long, email string").selectExpr("*", "'viewer' as role", "1L as invited_by")
    rows = lambda df: sorted((r["project_id"], r["invite_id"], r["reused"]) for r in df.collect())
    alone = [(2, 12, False), (3, 1, True), (3, 1, True)]
    assert rows(writers.create_invites(old, wanted, "2024-01-20 00:00:00", together=False)) == [(1, 10, False), (1, 11, False), *alone]
    assert rows(writers.create_invites(old, wanted, "2024-01-20 00:00:00")) == [(1, 10, False), (1, 10, True), *alone]
