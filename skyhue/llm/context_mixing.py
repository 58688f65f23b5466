"""Language-model scores by logistic mixing of bit predictors of several orders.

A text is its bytes and an end symbol; every byte is eight binary decisions. For each decision there is a predictor for each order 0 to ORDERS - 1: how many
zeros and ones came in training after the same last bytes and the same bits so far (a node). The predictors' log odds are combined by weights that a gate
picks (the bit's place, and the longest context seen before), and the result is refined by a table that adapts, for each partial byte, what the mix says to what came.

How that is learnt from a whole corpus: counts of strings of ORDERS bytes come from all training texts and are summed by Spark. Nodes are rows of tables, one table
an order, that grow with the corpus: a row is a string of a context and a byte, named by its bytes themselves, not by a hash, with the counts of the eight nodes on
the byte's path. No two contexts share counts, and neither the driver nor a task holds a table whole. Each order's rows are joined to those of the next one, so that every different
string has its nodes of all orders; strings of texts that are only scored take part with a count of 0.

An online learner predicts before it counts; so here every string is predicted from nodes without one occurrence of itself. Weights are learnt online within a task, one
batch of strings after the other, and the tasks' weights are averaged, over a few rounds. Weights and the refining table are parameters of the mix, of fixed size.

Once learnt, a decision depends on ORDERS bytes alone. Texts are dealt to parts; the different strings of each part are joined to their log probabilities and
meet the part's texts again. Texts go as compressed blocks, written tables are compressed hard, and the nodes are deleted when the log probabilities are known: what lies on
disk at once is several times the input otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyhue.llm import arrow_text as A
from skyhue.llm.tables import ship, staged, text_key
from skyhue.sources.staging import discard

#: Bytes that a decision depends on, the predicted one included (at most 7, so that codes are positive longs); rounds of learning.
ORDERS, ROUNDS = 6, 3
BATCH, RATE = 1 << 13, 0.4
STEPS = 33  # of the refining table
END = 0xFF  # no byte of UTF-8
#: Words of at least 1 / FREQUENT of all training tokens go along with the tasks: at most FREQUENT of them. Counts of the others are joined.
FREQUENT = 1 << 22
END_TOKEN = np.uint64(0x2545F4914F6CDD1D)
BLOCK = 1 << 20
#: Of written tables and blocks of texts.
CODEC = "zstd"
#: Bytes of text of a part, about; a longer text is a part of its own.
PART = 3 << 24
#: Counts are kept in 16 bits: as they are up to EXACT, then in steps of 1 / STEPS_E of their logarithm (to 1e13).
EXACT, STEPS_E = 32_768, 1600
LEVELS = np.concatenate([np.arange(EXACT), EXACT * np.exp(np.arange(65_536 - EXACT) / STEPS_E)]).astype(np.float32)


def strings(block: A.Block) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ORDERS bytes ending at each byte and at the end symbol, texts one after the other, and where each text's begin (and the end).
    Before a text stand zeros."""
    n, rows = len(block.data), len(block.offsets) - 1
    data = np.full(n + rows, END, dtype=np.uint64)
    row = np.repeat(np.arange(rows), np.diff(block.offsets))
    data[np.arange(n) + row] = block.data
    bounds = block.offsets + np.arange(rows + 1)
    code = data.copy()
    for k in range(1, ORDERS):
        moved = np.zeros_like(data)
        moved[k:] = data[:-k] if k < len(data) else data[:0]
        for j in range(k):  # nothing from the text before
            at = bounds[:-1] + j
            moved[at[at < bounds[1:]]] = 0
        code |= moved << np.uint64(8 * k)
    return code, bounds


def levels(n: np.ndarray) -> np.ndarray:
    """Places in LEVELS of counts."""
    steps = EXACT + np.round(np.log(np.maximum(n, EXACT) / EXACT) * STEPS_E)
    return np.where(n < EXACT, n, np.minimum(steps, 65_535)).astype(np.uint16)


def decisions(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each bit, from the highest: its place, partial byte before it, and the bit."""
    last = codes & np.uint64(0xFF)
    for j in range(8):
        node = (last >> np.uint64(8 - j)) | np.uint64(1 << j)
        yield j, node.astype(np.int64), ((last >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int8)


def odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds of a one after so many zeros and ones."""
    return np.log((n1 + 0.3) / (n0 + 0.3)).astype(np.float32)


def inputs(nodes: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each decision, from the counts of its nodes (rows x ORDERS x 2): log odds by order and a constant, and the longest context seen before.
    With bit: without one occurrence of the decision."""
    x = np.empty((len(nodes), ORDERS + 1), dtype=np.float32)
    x[:, ORDERS] = 0.3
    seen = np.zeros(len(nodes), dtype=np.int64)
    for k in range(ORDERS):
        a, b = LEVELS[nodes[:, k, 0]], LEVELS[nodes[:, k, 1]]
        if bit is not None:
            a, b = np.maximum(a - (bit == 0), 0), np.maximum(b - (bit == 1), 0)
        x[:, k] = odds(a, b)
        many = a + b
        seen[many > 0] = 2 * k
        seen[many > 3] = 2 * k + 1
    return x, seen


GATES = 8 * 2 * ORDERS


def gate(j: int, seen: np.ndarray) -> np.ndarray:
    return j * 2 * ORDERS + seen


def mix(x: np.ndarray, g: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ij->i", x, weights[g]), -12, 12)


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _at(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower step of the refining table and the share of the next one."""
    place = (z + 12) * ((STEPS - 1) / 24)
    low = np.minimum(place.astype(np.int64), STEPS - 2)
    return low, place - low


def _log10(codes: np.ndarray, nodes: np.ndarray, weights: np.ndarray, refine: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes))
    for j, node, bit in decisions(codes):
        x, seen = inputs(nodes[:, :, j], None)
        z = mix(x, gate(j, seen), weights)
        low, part = _at(z)
        refined = refine[node, low] * (1 - part) + refine[node, low + 1] * part
        z = (z + refined) / 2
        total -= np.logaddexp(0, np.where(bit == 1, -z, z))
    return total / np.log(10)


@dataclass
class Model:
    grams: DataFrame  # code, n
    rows: DataFrame  # code, n, nodes
    weights: np.ndarray
    refine: np.ndarray  # log odds by partial byte and step

    def costs(self, rows: DataFrame | None = None) -> DataFrame:
        """code, cost: log10 probability of the last byte of each string, given the others."""
        weights, refine = self.weights, self.refine

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for codes, _, nodes in _rows(batches):
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(_log10(codes, nodes, weights, refine).astype(np.float32))], ["code", "cost"])

        return (self.rows if rows is None else rows).mapInArrow(run, "code bigint, cost float")

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """The same of a few strings, seen or not, brought to the driver."""
        asked = self.grams.sparkSession.createDataFrame(pa.table({"code": np.unique(codes).view(np.int64)}))
        grams = self.grams.unionByName(asked.withColumn("n", F.lit(0).cast("long"))).groupBy("code").agg(F.sum("n").alias("n"))
        got = self.costs(nodes_of(grams).join(asked, "code", "left_semi")).toArrow()
        at = got.column("code").to_numpy().view(np.uint64)
        order = np.argsort(at)
        return got.column("cost").to_numpy().astype(np.float64)[order][np.searchsorted(at[order], codes)]


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=CODEC)) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _nullable(t: pa.DataType) -> pa.DataType:
    """The type as a written table has it: parts may be null."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in t])
    return pa.list_(_nullable(t.value_type)) if pa.types.is_list(t) else t


def _unpacked(packed: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for rows in packed:
        yield from pa.ipc.open_stream(rows.as_buffer())


def _split(docs: DataFrame) -> DataFrame:
    """docs (id, held_out, tk, text) -> kind, part, code, n, texts. Kind 0: words of training texts, and their end as a token; 1: strings of bytes of a
    part, n being how often they stand in its training texts; 2: a block of the part's texts, rows of docs. Each task combines what it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        rows = size = made = 0
        task = TaskContext.get().partitionId() << 32

        def combine(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([p[0] for p in parts])
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], np.concatenate([p[1] for p in parts])[order]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            return codes[first], np.add.reduceat(n, first)

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            parts, held[kind] = held[kind], []
            if parts:
                codes, n = combine(parts)
                for at in range(0, len(codes), 1 << 16):
                    some = codes[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), kind, dtype=np.int8)), pa.array(np.full(len(some), task + made)), pa.array(some.view(np.int64)), pa.array(n[at : at + (1 << 16)].astype(np.int64)), pa.nulls(len(some), pa.binary())],
                        names,
                    )

        for block in A.blocks(batches, "text", BLOCK):
            if size and size + len(block.data) > PART:
                yield from flush(1)
                made, size = made + 1, 0
            size += len(block.data)
            train = ~block.rows.column(block.rows.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
            rows += int(train.sum())
            w = A.words(block)
            codes, bounds = strings(block)
            for kind, (codes, counted) in enumerate(((A.word_hashes(block, w)[train[w.row]], None), (codes, np.repeat(train, np.diff(bounds))))):
                if len(codes):
                    unique, where, times = np.unique(codes, return_inverse=True, return_counts=True)
                    held[kind].append((unique, times if counted is None else np.bincount(where, counted, len(unique)).astype(np.int64)))
                if len(held[kind]) >= 8:
                    held[kind] = [combine(held[kind])]
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([task + made]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([_packed(block.rows)], pa.binary())], names)
        if rows:
            held[0].append((np.array([END_TOKEN]), np.array([rows])))
        for kind in (0, 1):
            yield from flush(kind)

    names = ["kind", "part", "code", "n", "texts"]
    return docs.mapInArrow(run, "kind tinyint, part bigint, code bigint, n bigint, texts binary")


def _summed(parts: DataFrame) -> DataFrame:
    return parts.where("kind < 2").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame) -> DataFrame:
    """Training texts (text) -> kind (0: words, and the end as a token; 1: strings of bytes), code, n."""
    return _summed(_split(docs.select(F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (code, n) of one order, sorted by code, a context's in one task -> code, n, own: zeros and ones of the eight nodes on the last byte's path."""

    def done(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        sums, path = np.r_[0, np.cumsum(n)], np.empty((9, len(codes)), dtype=np.int64)
        for j in range(9):  # strings that agree up to the j-th bit of the last byte stand together
            node = codes >> np.uint64(8 - j)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            ends = np.r_[first[1:], len(codes)]
            path[j] = np.repeat(sums[ends] - sums[first], ends - first)
        own = np.empty((len(codes), 8, 2), dtype=np.uint16)
        for j, _, bit in decisions(codes):
            same, other = levels(path[j + 1]), levels(path[j] - path[j + 1])
            own[:, j, 0], own[:, j, 1] = np.where(bit == 0, same, other), np.where(bit == 1, same, other)
        offsets = pa.py_buffer(np.arange(0, 32 * len(codes) + 1, 32, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n), pa.Array.from_buffers(pa.binary(), len(codes), [None, offsets, pa.py_buffer(own)])], ["code", "n", "own"])

    codes, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        codes, n = np.concatenate([codes, batch.column(0).to_numpy().view(np.uint64)]), np.concatenate([n, batch.column(1).to_numpy()])
        if len(codes):
            whole = int(np.searchsorted(codes >> np.uint64(8), codes[-1] >> np.uint64(8)))  # the last context may go on: at most 256 rows
            if whole:
                yield done(codes[:whole], n[:whole])
            codes, n = codes[whole:], n[whole:]
    if len(codes):
        yield done(codes, n)


def nodes_of(grams: DataFrame) -> DataFrame:
    """Strings (code, n) -> code, n, nodes: counts of the nodes of every order, from 0 on."""
    orders = [grams]
    for k in range(ORDERS - 2, -1, -1):
        last = F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        orders.append(staged(orders[-1].groupBy(last.alias("code")).agg(F.sum("n").alias("n")), CODEC))
    have = None
    for k, rows in enumerate(reversed(orders)):
        dealt = rows.select("code", "n").repartition(F.shiftright("code", 8)).sortWithinPartitions("code")
        own = dealt.mapInArrow(_paths, "code bigint, n bigint, own binary")
        if have is None:
            have = own.withColumnRenamed("own", "nodes")
        else:
            shorter = have.select(F.col("code").alias("last"), "nodes")
            own = own.withColumn("last", F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)))
            have = own.join(shorter, "last").select("code", "n", F.concat("nodes", "own").alias("nodes"))
        if k < ORDERS - 1:
            have = staged(have, CODEC)
    return have


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (code, n, nodes), BATCH at a time: codes, counts, and nodes (rows x ORDERS x 8 x 2)."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            nodes = batch.column(2)
            start = np.frombuffer(nodes.buffers()[1], dtype=np.int32)[nodes.offset]
            held = np.frombuffer(nodes.buffers()[2], dtype=np.uint16, count=len(nodes) * ORDERS * 16, offset=int(start))
            yield batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.float64), held.reshape(-1, ORDERS, 8, 2)


def _learnt(found: DataFrame, weights: np.ndarray) -> np.ndarray:
    """One round: every task starts from the weights and learns online; their results are averaged by what each gate has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, square, mass = weights.copy(), np.full(weights.shape, 1e-3), np.zeros(GATES)
        for some, times, nodes in _rows(batches):
            for j, _, bit in decisions(some):
                x, seen = inputs(nodes[:, :, j], bit)
                g = gate(j, seen)
                miss = times * (bit - squash(mix(x, g, w)))
                per = np.bincount(g, times, GATES)
                step = np.stack([np.bincount(g, miss * x[:, k], GATES) for k in range(x.shape[1])], axis=1) / np.maximum(per, 1)[:, None]
                square += step * step
                w += RATE * step / np.sqrt(square)
                mass += per
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES, dtype=np.int32)), pa.array(mass), pa.array(list(w * mass[:, None]), pa.list_(pa.float64()))], ["gate", "mass", "w"])

    parts = found.mapInArrow(run, "gate int, mass double, w array<double>").groupBy("gate").agg(F.sum("mass").alias("mass"), *(F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(ORDERS + 1)))
    new = weights.copy()
    for row in parts.collect():  # a row for each gate
        if row["mass"] > 0:
            new[row["gate"]] = [row[f"w{k}"] / row["mass"] for k in range(ORDERS + 1)]
    return new


def _refined(found: DataFrame, weights: np.ndarray) -> np.ndarray:
    """What came, by partial byte and what the mix said."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 256 * STEPS))
        for codes, n, nodes in _rows(batches):
            for j, node, bit in decisions(codes):
                x, seen = inputs(nodes[:, :, j], bit)
                low, part = _at(mix(x, gate(j, seen), weights))
                for to, share in ((low, 1 - part), (low + 1, part)):
                    for k in (0, 1):
                        total[k] += np.bincount(node * STEPS + to, n * share * (bit == k), 256 * STEPS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256 * STEPS, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["cell", "n0", "n1"])

    centre = np.tile(np.linspace(-12, 12, STEPS), 256)
    n = np.stack([squash(-centre), squash(centre)]) * 4  # what each step says itself counts as a few
    for row in found.mapInArrow(run, "cell int, n0 double, n1 double").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():  # 256 * STEPS rows
        n[:, row["cell"]] += row["n0"], row["n1"]
    return np.log(n[1] / n[0]).reshape(256, STEPS)


def learn(found: DataFrame) -> Model:
    """From counts (see `counts`, staged). Strings with a count of 0 are there to be scored."""
    grams = found.where("kind = 1").select("code", "n")
    # dealt by a join already; in no order, as weights are learnt online
    rows = staged(nodes_of(grams).sortWithinPartitions(F.xxhash64("code")), CODEC)
    weights, seen = np.full((GATES, ORDERS + 1), 0.3), rows.where("n > 0")
    for _ in range(ROUNDS):
        weights = _learnt(seen, weights)
    return Model(grams, rows, weights, _refined(seen, weights))


def scored(docs: DataFrame, held_out, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows where held_out (a Boolean column of docs) is false. Tokens: words with A-Z in lower case, then one end. base_score sums
    log10((c + 1) / (N + V + 1)) over tokens: c is the token's count, N that of all, V of different ones in training. score is the model's log10 probability of the
    text's bytes and its end, bits_per_byte the same in bits over the number of the bytes (null without bytes). Equal words are told by 64-bit hashes.

    Null texts are empty: just the end. Rows that repeat one another count as often in training, and each gets the same scores. No training rows: N and V are
    0, and every decision is even odds. An empty table gives no rows. Further columns are ignored.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select("id", "held_out", text_key("text").alias("tk"), "text")
    parts = staged(_split(base), CODEC)
    found = staged(_summed(parts), CODEC)
    total = found.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    model = learn(found)
    known_costs = staged(model.costs(), CODEC)
    discard(model.rows)
    often = found.where((F.col("kind") == 0) & (F.col("n") * FREQUENT >= n)).select("code", "n").toArrow()  # FREQUENT rows at most
    codes = often.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((codes[order], np.log10(often.column("n").to_numpy()[order] + 1.0)))

    def one(block: A.Block, code: np.ndarray, cost: np.ndarray) -> pa.RecordBatch:
        frequent, logs = known.value
        rows = block.rows.num_rows
        w = A.words(block)
        h = np.concatenate([A.word_hashes(block, w), np.full(rows, END_TOKEN)])
        row = np.concatenate([w.row, np.arange(rows)])
        at = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
        hit = frequent[at] == h if len(frequent) else np.zeros(len(h), dtype=bool)
        part = np.bincount(row[hit], logs[at[hit]], rows) if len(frequent) else np.zeros(rows)
        order = np.argsort(row[~hit], kind="stable")
        rare, rare_row = h[~hit][order], row[~hit][order]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare_row, np.arange(rows + 1)).astype(np.int32)), pa.array(rare.view(np.int64)))
        text_codes, bounds = strings(block)
        unique, where = np.unique(text_codes, return_inverse=True)
        score = np.add.reduceat(cost[np.searchsorted(code, unique)][where], bounds[:-1])

        def column(name: str) -> pa.Array:
            c = block.rows.column(block.rows.schema.get_field_index(name))
            return c.cast(_nullable(c.type))

        return pa.RecordBatch.from_arrays(
            [column("id"), column("held_out"), column("tk"), pa.array(np.diff(block.offsets)), pa.array(w.count + 1), pa.array(np.bincount(row[hit], minlength=rows)), pa.array(part), pa.array(score), lists],
            ["id", "held_out", "tk", "n_bytes", "n_tokens", "known", "logs", "score", "rare"],
        )

    def run(texts: pa.Table, costs: pa.Table) -> pa.Table:
        code, cost = costs.column("code").to_numpy().view(np.uint64), costs.column("cost").to_numpy().astype(np.float64)
        order = np.argsort(code)
        code, cost = code[order], cost[order]
        return pa.Table.from_batches([one(block, code, cost) for block in A.blocks(_unpacked(texts.column("texts")), "text", BLOCK)])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    texts = parts.where("kind = 2").select("part", "texts").groupBy("part")
    # a text has its end at least, so each part has texts and strings
    costs = parts.where("kind = 1").select(F.col("part").alias("of"), "code").join(known_costs, "code").groupBy("of")
    schema = f"id {kinds['id']}, held_out boolean, tk {kinds['tk']}, n_bytes bigint, n_tokens bigint, known bigint, logs double, score double, rare array<bigint>"
    rows = staged(texts.cogroup(costs).applyInArrow(run, schema))
    # words that aren't frequent: their counts are joined; of texts that repeat, all copies' words are summed, then shared out
    words = rows.select("tk", F.explode("rare").alias("code")).groupBy("tk", "code").agg(F.count("*").alias("times"))
    rare = words.join(found.where("kind = 0").select("code", "n"), "code").groupBy("tk").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"), F.sum("times").alias("more_known"))
    copies = rows.groupBy("tk").agg(F.count("*").alias("copies"))
    per = copies.join(rare, "tk").select("tk", (F.col("more_logs") / F.col("copies")).alias("more_logs"), F.floor(F.col("more_known") / F.col("copies")).alias("more_known"))
    out = rows.drop("rare").join(per, "tk", "left")
    return out.select(
        F.col("id").alias(id), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
