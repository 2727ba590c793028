"""Withdrawals and reports about their transactions, in either order."""

from pyspark.sql import functions as F

from tallybook.catalog.accounts import _DETAILS
from tallybook.operators.reconcile import confirm_withdrawals
from tallybook.plans.lineage import Workspace
from tallybook.streaming.withdrawals import stream_confirmed

REPORTS = ["txid", "n", "category", "confirmations", "address", "amount", "fee"]


def test_withdrawals_between_batches(spark, tables):
    """Reports with few confirmations, withdrawals, final reports, late and repeated withdrawals: each is confirmed once."""
    space = Workspace(spark, "t-meet")
    # Ranks of equal places are told apart in the fixture by amounts of one width.
    final = space.store(tables.sql(_DETAILS).select(*REPORTS), "final")
    sent = space.store(tables.action.where("txid IS NOT NULL").select("action_id", "txid"), "all-sent")
    early = final.withColumn("confirmations", F.lit(1).cast(final.schema["confirmations"].dataType))

    def put(name, df):
        df.coalesce(1).write.mode("append").parquet(space.path(name))

    put("reports", early.limit(0))
    put("sent", sent.limit(0))
    streams = [
        spark.readStream.schema(df.schema).parquet(space.path(name)) for name, df in (("sent", sent), ("reports", final))
    ]
    counts = []
    for k, step in enumerate([[("reports", early)], [("sent", sent.where("action_id % 20 < 10"))], [("reports", final)], [("sent", sent)], [("reports", final)]]):
        for name, df in step:
            put(name, df)
        query = (
            stream_confirmed(*streams).writeStream.format("parquet").option("path", space.path("out"))
            .option("checkpointLocation", space.path("checkpoint")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        counts.append(spark.read.schema("action_id long").parquet(space.path("out")).count())
    want = confirm_withdrawals(final.select("txid").distinct(), final, sent)
    shown = lambda df: sorted(tuple(r) for r in df.select("action_id", "txid", "state", "txfee").collect())
    got = shown(spark.read.parquet(space.path("out")))
    assert got == shown(want)
    assert counts[0] == counts[1] == 0 < counts[2] < counts[3] == counts[4] == len(got)
