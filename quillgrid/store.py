"""Blocks of layers: building them row by row or in bulk, reading, dereferencing and updating them.

A layer is a DataFrame with a row number, `_fid`. A block in build mode gathers rows in the driver, as its callers push
them, and becomes fixed by `fix`; bulk data enters as DataFrames at once. Fixed layers are immutable: an update returns
a block with new snapshots, which share everything else.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stored
from .types import BY_NAME, FID, REF_TYPE, Feature, field, fields_of, schema_of

NAMES = "_name_"
NAME_SCHEMA = T.StructType([T.StructField(FID, T.LongType(), False), field("name", "str"), field("ref", "ref")])


def with_fid(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with row numbers from 0 in a declared order, computed without one task for all rows. Rows that tie get theirs in any order.

    Rows are range-partitioned by the order, sorted and written once with their place in their partition. Both the sizes
    of the partitions and the numbers come from that table: a plan that partitions twice samples, and coalesces, anew.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)  # the partition stands above the place within it
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(FID, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).select(FID, *df.columns)


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns as the schema's, nulls as their types' defaults."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        default = BY_NAME[f.metadata["ft"]].default if "ft" in f.metadata else None
        if default is not None:
            c = F.coalesce(c.cast(f.dataType), F.lit(default).cast(f.dataType))
        out.append(c.alias(f.name, metadata=f.metadata))
    return df.select(*out)


class Layer:
    """A named, fixed layer."""

    def __init__(self, name: str, df: DataFrame, index: int):
        self.name, self.df, self.index = name, df, index

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, i: int) -> Row:
        """The row of a number; a filter on the row number reaches the scan."""
        row = self.df.where(F.col(FID) == i).first() if i >= 0 else None
        if row is None:
            raise IndexError(i)
        return row

    def get(self, i: int) -> Row | None:
        return self.df.where(F.col(FID) == i).first()

    def __iter__(self) -> Iterator[Row]:
        """All rows in order, a partition at a time."""
        return self.df.orderBy(FID).toLocalIterator()

    def column(self, name: str) -> DataFrame:
        return self.df.select(FID, name)

    @property
    def fields(self) -> list[T.StructField]:
        return [f for f in self.df.schema.fields if f.name != FID]

    def extent(self, x: str, y: str) -> DataFrame:
        return self.df.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))

    def summary(self) -> str:
        lines = [f"{self.index} {self.name}: {len(self)} rows"]
        for f in self.fields:
            span = f" [{f.metadata['vmin']}, {f.metadata['vmax']}]" if "vmin" in f.metadata else ""
            lines.append(f"  {f.name} {f.metadata.get('ft', f.dataType.simpleString())}{span}")
        return "\n".join(lines)


def dereference(parents: DataFrame, ref: str, child: DataFrame, prefix: str, layer: int | None = None) -> DataFrame:
    """parents with the columns of the rows their reference names, prefixed; null where it leads nowhere.

    An equality join on the row number: Spark broadcasts the child layer when its size allows.
    """
    c = child.select(*[F.col(n).alias(f"{prefix}{n}") for n in child.columns])
    on = F.col(f"{ref}.ifeature") == F.col(f"{prefix}{FID}")
    if layer is not None:
        on = on & (F.col(f"{ref}.ilayer") == layer)
    return parents.join(c, on, "left")


def _field(schema: T.StructType, at: tuple[str, ...], kind: str) -> Column:
    """A field of nested structs as its layer's column; its default where a struct or the field is missing or null."""
    here: T.DataType = schema
    for name in at:
        here = here[name].dataType if isinstance(here, T.StructType) and name in here.names else None
    default = F.lit(BY_NAME[kind].default).cast(BY_NAME[kind].spark)
    column = default if here is None else F.coalesce(F.col(".".join(f"`{n}`" for n in at)).cast(BY_NAME[kind].spark), default)
    return column.alias(at[-1], metadata={"ft": kind})


class Block:
    """An ordered set of layers."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.layers: dict[str, Layer] = {}
        self._rows: dict[str, list[tuple]] | None = None
        self._schemas: dict[str, T.StructType] = {}

    @classmethod
    def create(cls, spark: SparkSession) -> Block:
        """An empty block in build mode, with the layer of names."""
        self = cls(spark)
        self._rows = {NAMES: []}
        self._schemas = {NAMES: NAME_SCHEMA}
        return self

    @classmethod
    def of(cls, spark: SparkSession, layers: dict[str, DataFrame]) -> Block:
        """A fixed block of DataFrames that have row numbers."""
        self = cls(spark)
        self.layers = {n: Layer(n, df, i) for i, (n, df) in enumerate(layers.items())}
        return self

    @classmethod
    def truncate(cls, spark: SparkSession, scales: list[tuple[type[Feature], int, str]]) -> Block:
        """A fixed block of rows of defaults: (class, capacity, layer name). Each reference gets a default row of its own,
        appended to the layer named after its class."""
        block = cls(spark)
        sizes: dict[str, int] = {}
        plan: dict[str, tuple[type[Feature], list[DataFrame]]] = {}
        order: list[str] = []

        def place(kind: type[Feature], n: int, name: str) -> int:
            if name not in order:
                order.append(name)
                sizes[name] = 0
                plan[name] = (kind, [])
            begin = sizes[name]
            sizes[name] += n
            base = spark.range(n).select((F.col("id") + begin).alias(FID))
            for f, t in fields_of(kind).items():
                if isinstance(t, type):
                    child = place(t, n, t.__name__)
                    base = base.withColumn(f, F.struct(F.lit(order.index(t.__name__)).alias("ilayer"), (F.col(FID) - begin + child).alias("ifeature")))
                else:
                    base = base.withColumn(f, F.lit(BY_NAME[t].default).cast(BY_NAME[t].spark))
            plan[name][1].append(base)
            return begin

        for kind, capacity, name in scales:
            if capacity <= 0 or not issubclass(kind, Feature):
                raise ValueError(f"{name}: a layer needs a schema class and a capacity over 0")
            place(kind, capacity, name)
        for i, name in enumerate(order):
            kind, parts = plan[name]
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            block.layers[name] = Layer(name, df, i)
        return block

    @classmethod
    def push_all(cls, spark: SparkSession, kind: type[Feature], rows: DataFrame, *order: str | Column, layer: str | None = None) -> Block:
        """A fixed block of many rows of a schema class, as `push` of one after another in this order would build it.

        rows has the class's fields as columns, references as structs of their class's fields; missing columns and nulls are
        defaults. Each reference gets a row of its own, numbered from its parent's number, so only the parents are sorted.
        """
        layers: dict[str, tuple[type[Feature], list[tuple[tuple[str, ...], dict[str, tuple[str, int]]]]]] = {}

        def plan(of: type[Feature], at: tuple[str, ...], name: str) -> tuple[str, int]:
            layers.setdefault(name, (of, []))
            refs = {f: plan(t, (*at, f), t.__name__) for f, t in fields_of(of).items() if isinstance(t, type)}
            layers[name][1].append((at, refs))
            return name, len(layers[name][1]) - 1

        plan(kind, (), layer or kind.__name__)
        numbered = with_fid(rows, *order)
        index = {n: i for i, n in enumerate(layers)}
        out: dict[str, DataFrame] = {}
        for name, (of, places) in layers.items():
            parts = []
            for nth, (at, refs) in enumerate(places):
                cols = [(F.col(FID) * len(places) + nth).alias(FID)]
                for f, t in fields_of(of).items():
                    if isinstance(t, type):
                        other, i = refs[f]
                        cols.append(F.struct(F.lit(index[other]).alias("ilayer"), (F.col(FID) * len(layers[other][1]) + i).alias("ifeature")).alias(f))
                    else:
                        cols.append(_field(numbered.schema, (*at, f), t))
                parts.append(numbered.select(*cols))
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            out[name] = df
        return cls.of(spark, out)

    @property
    def fixed(self) -> bool:
        return self._rows is None

    def push(self, row: Feature, layer: str | None = None, name: str | None = None) -> tuple[int, int]:
        """Append a row, and one for each of its references to the layers named after their classes; its reference."""
        if self._rows is None:
            raise RuntimeError("a fixed block takes no rows")
        kind = type(row)
        layer = layer or kind.__name__
        if len(layer.encode()) > 63:
            raise ValueError(f"layer name {layer!r} is longer than 63 bytes")
        if layer not in self._rows:
            self._rows[layer], self._schemas[layer] = [], schema_of(kind)
        values: list[object] = []
        for f, t in fields_of(kind).items():
            v = getattr(row, f)
            values.append(self.push(v) if isinstance(t, type) else v)
        rows = self._rows[layer]
        ref = list(self._rows).index(layer), len(rows)
        rows.append((len(rows), *values))
        if name is not None:
            names = self._rows[NAMES]
            names.append((len(names), name, ref))
        return ref

    def fix(self) -> Block:
        if self._rows is not None:
            for i, (name, rows) in enumerate(self._rows.items()):
                self.layers[name] = Layer(name, self.spark.createDataFrame(rows, self._schemas[name]), i)
            self._rows = None
        return self

    def __len__(self) -> int:
        return len(self._rows if self._rows is not None else self.layers)

    def __getitem__(self, key: int | str | type[Feature]) -> Layer:
        if not self.fixed:
            raise RuntimeError("a block is read once it is fixed")
        if isinstance(key, int):
            return list(self.layers.values())[key]
        return self.layers[key if isinstance(key, str) else key.__name__]

    def get(self, name: str) -> Row | None:
        """The row that a name was given to first."""
        if NAMES not in self.layers:
            raise KeyError("this block has no layer of names")
        ref = self.layers[NAMES].df.where(F.col("name") == name).orderBy(FID).select("ref.*").first()
        return None if ref is None else self.at(ref["ilayer"], ref["ifeature"])

    def at(self, ilayer: int, ifeature: int) -> Row | None:
        layers = list(self.layers.values())
        return layers[ilayer].get(ifeature) if 0 <= ilayer < len(layers) else None

    def replaced(self, layer: str, df: DataFrame) -> Block:
        out = Block(self.spark)
        out.layers = {n: Layer(n, df if n == layer else x.df, x.index) for n, x in self.layers.items()}
        return out

    def update_cell(self, layer: str, row: int, name: str, value: object) -> Block:
        d = self.layers[layer].df
        kind = d.schema[name]
        if kind.metadata.get("ft") in ("str", "wstr", "bytes", "ref") or not isinstance(kind.dataType, T.NumericType):
            raise TypeError(f"{name}: only numeric cells are overwritten")
        new = F.when(F.col(FID) == row, F.lit(value).cast(kind.dataType)).otherwise(F.col(name)).alias(name, metadata=kind.metadata)
        return self.replaced(layer, d.select(*[new if c == name else c for c in d.columns]))

    def update_column(self, layer: str, name: str, expr: Column) -> Block:
        d = self.layers[layer].df
        kind = d.schema[name]
        return self.replaced(layer, d.select(*[expr.cast(kind.dataType).alias(name, metadata=kind.metadata) if c == name else c for c in d.columns]))

    def assign_ref(self, layer: str, row: int, name: str, source: tuple[int, int]) -> Block:
        """Assign a reference by value: the fields of the source row are copied into the row that is referenced now."""
        ref = self.layers[layer].get(row)[name]
        target = list(self.layers.values())[ref["ilayer"]]
        value = self.at(*source)
        d = target.df
        cols = [F.when(F.col(FID) == ref["ifeature"], F.lit(value[c]).cast(d.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c != FID and d.schema[c].dataType != REF_TYPE else F.col(c) for c in d.columns]
        return self.replaced(target.name, d.select(*cols))

    def save(self, path: str) -> None:
        """A Parquet folder a layer, numbered to keep the layers' order."""
        for x in self.fix().layers.values():
            x.df.write.mode("overwrite").parquet(f"{path}/{x.index:04d}_{x.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Block:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            raise FileNotFoundError(path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        return cls.of(spark, {n[5:]: spark.read.parquet(f"{path}/{n}") for n in names if n[:4].isdigit()})

    def share(self, name: str) -> None:
        """Publish the layers to all sessions of the application, as global temporary views."""
        for x in self.fix().layers.values():
            x.df.createOrReplaceGlobalTempView(f"{name}__{x.index:04d}_{x.name}")

    @classmethod
    def attach(cls, spark: SparkSession, name: str) -> Block:
        views = sorted(t.name for t in spark.catalog.listTables("global_temp") if t.name.startswith(f"{name}__".lower()) or t.name.startswith(f"{name}__"))
        if not views:
            raise FileNotFoundError(name)
        return cls.of(spark, {v.split("__", 1)[1][5:]: spark.table(f"global_temp.{v}") for v in views})

    def close(self) -> None:
        """Drop the layers: the block holds none and takes none from here on. What was saved or shared stays."""
        self.layers, self._rows, self._schemas = {}, None, {}

    def __enter__(self) -> Block:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def unlink(self, name: str) -> None:
        for x in self.layers.values():
            self.spark.catalog.dropGlobalTempView(f"{name}__{x.index:04d}_{x.name}")
