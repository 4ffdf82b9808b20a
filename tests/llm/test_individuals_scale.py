import os
import random

from test_records import CONTACT, contact

from shaleview.llm import individuals, names
from shaleview.llm.common import checkpoint_dir


def profiles(spark, mails):
    rows = [(i, m, "", "", "", "", "", "", False, False) for i, m in enumerate(mails)]
    return spark.createDataFrame(rows, "pid long, email string, dob string, phone string, given string, family string, house string, street string, hot_email boolean, hot_phone boolean")


def test_near_mailboxes_equal_all_pairs(spark):
    rng = random.Random(7)
    local = {"".join(rng.choice("ab1") for _ in range(rng.randrange(4, 11))) for _ in range(300)}
    mails = [f"{x}@{h}.test" for x in local for h in "xy" if rng.random() < 0.7]
    p = profiles(spark, mails + mails[:20])
    got = [tuple(r) for r in individuals.near_mailboxes(p).collect()]
    host = lambda m: m.split("@")[1]
    want = {(a, b) for a in mails for b in mails if a < b and host(a) == host(b) and names.near(a.split("@")[0], b.split("@")[0])}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 200
    assert all(host(a) == host(b) and sorted(a) == sorted(b) for a, b in set(got) - want)  # two letters exchanged further apart


def test_strangers_with_like_mailboxes_share_no_key(spark):
    """Their pairs grew with the square of the table."""
    rng = random.Random(8)
    p = profiles(spark, sorted({f"oliver_{rng.randrange(10**6, 10**7)}@box.test" for _ in range(400)}))
    k = individuals.block_keys(p)
    assert k.groupBy("key").count().where("count > 1").count() == 0
    assert individuals.near_mailboxes(p).count() < 20


def test_letters_odd_keeps_near_names(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) for _ in range(120)]
    d = spark.createDataFrame([(w,) for w in words], "w string").withColumn("o", individuals.letters_odd("w"))
    both = d.select(d.w.alias("x"), d.o.alias("a")).crossJoin(d.select(d.w.alias("y"), d.o.alias("b")))
    assert both.where(individuals.near(both.x, both.y)).where("bit_count(a ^ b) > 2").count() == 0


def test_tables_that_nothing_reads_are_deleted(spark):
    at = checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    rows = [contact(f"r{i}", f"d{i}", f"{g} Marlcombe", f"{g}{i // 2}@box.test".lower(), f"19{40 + i // 2}-01-02", None) for i in range(40) for g in [("Wanda", "Ivan", "Leila")[i // 2 % 3]]]
    members, links, sure = individuals.matches(spark.createDataFrame(rows, CONTACT))
    left = {x.rpartition("-")[0] for x in set(os.listdir(at)) - before}
    assert left == {"p3-records", "p3-profiles", "p3-links", "p3-individuals"}
    assert members.count() == 40 and links.count() > 0 and sure.count() > 0
