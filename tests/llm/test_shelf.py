import os

from tidewatch.llm import shelf


def test_tables_come_and_go(spark):
    s = shelf.Shelf(spark, "test")
    one, two = s.put(spark.range(5)), s.put(spark.range(7))
    assert one.count() == 5 and two.count() == 7
    folder = s.folder.removeprefix("file:")
    s.take_off(one)
    assert os.listdir(folder) == ["1"]
    shelf.clear(spark)
    assert not os.path.exists(folder) and not shelf.FOLDERS
