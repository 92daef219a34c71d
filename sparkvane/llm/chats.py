"""Conversations from message rows (problem 2) and the order of rows within chats of any size.

No step gathers a chat in one task. Rows are range-partitioned by (chat, created, id), so that a large chat is cut into slices
that follow each other; each slice is ordered and summed up on its own, and only the summaries of slices meet per chat."""
import heapq

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import number, role_of, visible


def kahn(nodes, parents):
    """Kahn's algorithm over a reply graph with ties broken by the nodes' order.

    `nodes` are sortable keys, `parents` maps a node to the one it replies to. Returns (order, left): `left` are the nodes on
    or behind a cycle. A parent outside `nodes` counts as placed before."""
    waits, children = {}, {}
    for n in nodes:
        p = parents.get(n)
        if p is not None and (p in waits or p in parents or p == n):
            waits[n] = 1
            children.setdefault(p, []).append(n)
        else:
            waits[n] = 0
    heap = [n for n, k in waits.items() if not k]
    heapq.heapify(heap)
    order = []
    while heap:
        n = heapq.heappop(heap)
        order.append(n)
        for c in children.get(n, ()):
            waits[c] -= 1
            if not waits[c]:
                heapq.heappush(heap, c)
    placed = set(order)
    return order, [n for n in nodes if n not in placed]


def distinct_rows(messages, payload=()):
    """Rows equal in chat_id, role, content and created once, with the smallest id and that row's `payload`.

    Equality is null-safe and NaN counts as null. Content is compared by a SHA-256 digest, so texts are shuffled once at most."""
    m = messages.select("id", "chat_id", "role", "content", number(F.col("created")).alias("created"), *payload)
    first = F.min(F.struct("id", *payload)).alias("x") if payload else F.min(F.struct("id")).alias("x")
    keys = ["chat_id", "role", "created"]
    return (
        m.withColumn("_h", F.sha2("content", 256)).groupBy(*keys, "_h").agg(first, F.first("content").alias("content"))
        .select("x.*", *keys, "content"))


def turn_rows(messages):
    """Distinct rows that are turns or break a chat: no system or tool rows, no blank texts. Columns chat_id, id, created, role, bad."""
    m = messages.where(F.col("chat_id").isNotNull() & visible(F.col("content")))
    m = m.withColumn("_r", role_of(F.col("role"))).where(F.coalesce(F.col("_r") != "other", F.lit(True)))
    created = number(F.col("created"))
    keys = ["chat_id", "role", "_r", "created", "_h"]
    return (
        m.select("id", "chat_id", "role", "_r", created.alias("created"), F.sha2("content", 256).alias("_h"))
        .groupBy(*keys).agg(F.coalesce(F.min("id"), F.lit(-1)).alias("id"))
        .select("chat_id", "id", "created", F.col("_r").alias("role")))


SLICE = "chat_id string, slice int, n bigint, first_created double, first_id bigint, first_role string, last_role string, ok boolean, left_over bigint"


def _summary(chat, part, rows):
    """One summary of a chat's rows in a slice, by Kahn's algorithm over its reply graph.

    A row replies to the row before it in time. One without created or with an unknown role has no place: it waits for itself,
    which is a cycle, and is left over."""
    nodes, parents, before, at = [], {}, None, {}
    for created, i, role in rows:
        broken = created is None or created != created or role is None
        key = (0.0 if created is None or created != created else created, i if i is not None else -1, len(nodes))
        nodes.append(key)
        at[key] = role
        if broken:
            parents[key] = key
        else:
            if before is not None:
                parents[key] = before
            before = key
    order, left = kahn(nodes, parents)
    roles = [at[k] for k in order]
    ok = not left and all(a != b for a, b in zip(roles, roles[1:], strict=False))
    one = order[0] if order else nodes[0]
    return chat, part, len(nodes), one[0], one[1], roles[0] if roles else None, roles[-1] if roles else None, ok, len(left)


def _slices(batches):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    chat, rows = None, []
    for b in batches:
        out = []
        for c, created, i, role in zip(b["chat_id"].tolist(), b["created"].tolist(), b["id"].tolist(), b["role"].tolist(), strict=True):
            if c != chat:
                if rows:
                    out.append(_summary(chat, part, rows))
                chat, rows = c, []
            rows.append((created, i, role))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SLICE.split(", ")])
    if rows:
        yield pd.DataFrame([_summary(chat, part, rows)], columns=[x.split()[0] for x in SLICE.split(", ")])


def chat_states(messages, chats):
    """One row per non-null chat id of `messages` or `chats`: chat_id, turns, kept, and why not (`reason`).

    A chat's summary is the fold of its slices': turns alternate within each and across neighbours. Windows hold one row per
    slice, at most the number of partitions. Empty tables give no rows; repeated rows count once; other columns are not read."""
    t = turn_rows(messages).repartitionByRange("chat_id", "created", "id").sortWithinPartitions("chat_id", "created", "id")
    s = t.mapInPandas(_slices, SLICE)
    w = Window.partitionBy("chat_id").orderBy("slice")
    s = s.withColumn("_join", F.coalesce(F.lag("last_role").over(w) != F.col("first_role"), F.lag("n").over(w).isNull(), F.lit(False)))
    g = s.groupBy("chat_id").agg(
        F.sum("n").alias("turns"), F.sum("left_over").alias("left_over"), F.min(F.col("ok") & F.col("_join")).alias("ok"),
        F.min_by("first_role", "slice").alias("first_role"), F.max_by("last_role", "slice").alias("last_role"))
    known = chats.where("id is not null").select(F.col("id").alias("chat_id"), F.lit(True).alias("known"))
    seen = messages.where("chat_id is not null").select("chat_id", F.lit(None).cast("boolean").alias("known"))
    ids = known.unionByName(seen).groupBy("chat_id").agg(F.coalesce(F.max("known"), F.lit(False)).alias("known"))
    x = ids.join(g, "chat_id", "left")
    reason = (
        F.when(~F.col("known"), "not listed").when(F.col("turns").isNull(), "no turns").when(F.col("left_over") > 0, "broken row")
        .when(F.col("first_role") != "user", "no opening question").when(F.col("last_role") != "assistant", "missing reply")
        .when(~F.col("ok"), "no alternation"))
    return x.select("chat_id", F.coalesce("turns", F.lit(0)).alias("turns"), reason.isNull().alias("kept"), reason.alias("reason"))


def dropped(messages, chats):
    """Ids of the chats that are not intact."""
    return chat_states(messages, chats).where(~F.col("kept")).select("chat_id")


def _numbered(batches):
    from pyspark import TaskContext

    part, chat, k = TaskContext.get().partitionId(), None, 0
    for b in batches:
        pos = []
        for c in b["chat_id"].tolist():
            k = k + 1 if c == chat else 1
            chat = c
            pos.append(k)
        yield b.assign(slice=part, pos=pos)


#: Parts into which the rows of a chat are spread where they meet its state.
SALTS = 32


def conversations(messages, chats):
    """Ordered turns of the intact chats: chat_id, turn_no (from 1), role, content, created, id.

    Rows meet the list of intact chats on (chat, salt), so that a large chat is spread. Positions are counted within slices; the length
    of the earlier slices of a chat is added by a join on (chat, slice)."""
    keep = chat_states(messages, chats).where("kept").select("chat_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    m = messages.where(F.col("chat_id").isNotNull() & visible(F.col("content")))
    m = distinct_rows(m).withColumn("role", role_of(F.col("role"))).where("role in ('user', 'assistant')")
    t = m.withColumn("_s", F.pmod(F.xxhash64("id", "created"), F.lit(SALTS)).cast("int")).join(keep, ["chat_id", "_s"], "left_semi").select("chat_id", "created", "id", "role", "content")
    t = t.withColumn("id", F.coalesce("id", F.lit(-1)))
    t = t.repartitionByRange("chat_id", "created", "id").sortWithinPartitions("chat_id", "created", "id")
    t = checkpoint(t.mapInPandas(_numbered, "chat_id string, created double, id bigint, role string, content string, slice int, pos bigint"))
    sizes = t.groupBy("chat_id", "slice").agg(F.max("pos").alias("size"))
    w = Window.partitionBy("chat_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("chat_id", "slice", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start")).where("start > 0")
    return t.join(start, ["chat_id", "slice"], "left").select(
        "chat_id", (F.col("pos") + F.coalesce("start", F.lit(0))).alias("turn_no"), "role", "content", "created", "id")
