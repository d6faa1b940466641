"""What scratch deletes, and what it must not."""

import threading

from panelforge import session
from panelforge.session import Work, kept, scratch


def test_scratch_deletes_its_own_threads_tables_only(spark):
    made, go, done = {}, threading.Event(), threading.Event()

    def other():
        go.wait(60)
        work = Work(spark)
        made["other"] = work.cut(spark.range(3), "t")
        done.set()

    t = threading.Thread(target=other)
    t.start()
    with scratch():
        inner = Work(spark)
        inner.cut(spark.range(3), "t")
        with kept():
            made["kept"] = Work(spark).cut(spark.range(4), "t")
        with scratch():
            nested = Work(spark)
            nested.cut(spark.range(3), "t")
        go.set()
        assert done.wait(60)
    t.join()
    assert made["other"].count() == 3 and made["kept"].count() == 4
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration())
    for w in (inner, nested):
        assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(w.root))
    assert session._works.get() is None
