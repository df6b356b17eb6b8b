"""An index folder found by what is in it: files by kind and priority, ids replaced by the tickers of their time.

    root/Mapping.csv          for all indices, unless the index has its own
    root/INDEX/2019.csv ...   prices, a file a year
    root/INDEX/Compo.csv      compositions; also sector_mapping and Exclusions

The listing is a table; which file stands for what is decided on it by a rank of names and endings. Spark reads the
files, so any store that it knows will do. Excel files take part in the ranking, and one that ranks first is an
error rather than a silent choice of another, unless `endings` leaves them out.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackline.operators import calendars, slices, universe
from trackline.sources import files

# The endings and names that index folders have, the preferred ones first.
ENDINGS = ("xlsx", "xlsm", "xls", "csv")
NAMES = {"compositions": ("Compo", "compo"), "sectors": ("sector_mapping", "sectors_mapping"), "exclusions": ("Exclusions",)}
_LISTED = "folder string, name string, stem string, ending string, path string"


class IndexFolder:
    """The tables of one index.

    names: a file's name for a kind (compositions, sectors) instead of those that are searched; mapping: the name of the
    id mapping, or None for none.
    """

    def __init__(self, spark: SparkSession, root: str, index: str, endings: tuple[str, ...] = ENDINGS, names: dict[str, str] | None = None, mapping: str | None = "Mapping.csv"):
        self.spark, self.root, self.folder, self.endings = spark, root.rstrip("/"), f"{root.rstrip('/')}/{index}", endings
        self.names, self.mapping_name = names or {}, mapping
        self.listing = self._listed(self.root).unionByName(self._listed(self.folder, strict=True))

    def _listed(self, folder: str, strict: bool = False) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(place):
            if strict:
                raise FileNotFoundError(f"no folder {folder}")
            return self.spark.createDataFrame([], _LISTED)
        found = [(f.getPath().getName(), f.getPath().toString()) for f in store.listStatus(place) if f.isFile()]
        return self.spark.createDataFrame([(folder, n, n.rpartition(".")[0].strip() or n, n.rpartition(".")[2].lower(), p) for n, p in found], _LISTED)

    def _ranked(self) -> DataFrame:
        """The index's own files of known endings, with the rank of the ending."""
        rank = F.array_position(F.array(*[F.lit(e) for e in self.endings]), F.col("ending"))
        rows = self.listing.filter((F.col("folder") == self.folder) & F.col("ending").isin(list(self.endings)))
        return rows.withColumn("rank", rank)

    @staticmethod
    def _readable(path: str) -> str:
        if not path.lower().endswith(".csv"):
            raise ValueError(f"cannot read {path}; save it as CSV, or leave its ending out")
        return path

    def find(self, kind: str, optional: bool = False) -> str | None:
        """The file of a kind: the one that is named, else the first by name and then by ending."""
        named = self.names.get(kind)
        if named:
            row = self.listing.filter((F.col("folder") == self.folder) & (F.col("name") == named)).first()
        else:
            order = F.array_position(F.array(*[F.lit(s) for s in NAMES[kind]]), F.col("stem"))
            row = self._ranked().filter(F.col("stem").isin(list(NAMES[kind]))).orderBy(order, "rank").first()
        if row is None and not optional:
            raise FileNotFoundError(f"no file of {kind} in {self.folder}")
        return None if row is None else self._readable(row["path"])

    def year_files(self) -> DataFrame:
        """year, path: of the files of a year the one whose ending ranks first."""
        rows = self._ranked().filter(F.col("stem").rlike("^[0-9]{4}$"))
        return rows.groupBy(F.col("stem").cast("int").alias("year")).agg(F.min_by("path", "rank").alias("path"))

    def mapping(self) -> DataFrame | None:
        """date, ticker, id_global, id_company: of the index, else of the root, else none."""
        if self.mapping_name is None:
            return None
        own = F.when(F.col("folder") == self.folder, 0).otherwise(1)
        row = self.listing.filter(F.col("name") == self.mapping_name).orderBy(own).first()
        return None if row is None else files.read_mapping(self.spark, self._readable(row["path"]))

    def prices(self, start: datetime.date | None = None, end: datetime.date | None = None, assets: list[str] | None = None) -> DataFrame:
        """date, asset, price, year of a range; only files of its years are opened.

        An id is replaced by its latest ticker up to the end of the file's year, else by its last one, else it stays.
        """
        there = {r["year"]: r["path"] for r in self.year_files().collect()}
        if not there:
            raise FileNotFoundError(f"no files of years in {self.folder}")
        years = slices.needed_years(start, end, sorted(there))
        out = files.read_prices(self.spark, {y: self._readable(there[y]) for y in years}, mapping=self.mapping())
        return slices.take(out, str(start) if start else None, str(end) if end else None, assets)

    def compositions(self) -> DataFrame:
        """date, asset, weight: each date's weights scaled to one; an id counts as its latest ticker of that date."""
        blocks = files.read_blocks(self.spark, self.find("compositions"), self.mapping())
        rows = blocks.groupBy(F.col("eff_date").alias("date"), F.col("ticker").alias("asset")).agg(F.sum("weight").alias("weight"))
        return universe.normalise_weights(rows, "date")

    def weights_as_of(self, dates: DataFrame, exact: bool = False) -> DataFrame:
        """date, asset, weight: the composition in force at each date; with `exact`, of that very date, and a date without
        one is an error."""
        rows = self.compositions().withColumnRenamed("date", "eff_date")
        if exact:
            missing = [str(r["date"]) for r in calendars.missing_as_of(dates, rows).orderBy("date").limit(10).collect()]
            if missing:
                raise ValueError(f"no composition of {', '.join(missing)}")
        return calendars.as_of(dates.select("date").distinct(), rows, []).select("date", "asset", "weight")

    def sectors(self) -> DataFrame:
        """asset, sector; empty where there is no file."""
        path = self.find("sectors", optional=True)
        return files.read_sectors(self.spark, path) if path else self.spark.createDataFrame([], "asset string, sector string")

    def exclusions(self) -> DataFrame:
        """asset; empty where there is no file."""
        path, mapping = self.find("exclusions", optional=True), self.mapping()
        if mapping is None:
            mapping = self.spark.createDataFrame([], "date date, ticker string, id_global string, id_company string")
        return files.read_exclusions(self.spark, path, mapping) if path else self.spark.createDataFrame([], "asset string")
