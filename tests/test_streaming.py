"""Bundles that arrive one after the other."""

from corbel.streaming import arrivals


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.js").write_text('__d("A",[],(function(){}),1);__d("B",["A"],(function(){}),2);')
    stream = arrivals.new_contents(arrivals.arriving(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        (tmp_path / "in/b.js").write_text('__d("A",[],(function(){}),1);__d("B",["A"],(function(){x}),2);')
        query.processAllAvailable()
        assert sorted(r.name for r in spark.sql("SELECT name FROM arrivals").collect()) == ["A", "B", "B"]
    finally:
        query.stop()
