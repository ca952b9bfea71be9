"""Tables of immutable shards under size-tiered compaction.

Arrivals are appended as the small files that their tasks write.  Compaction
puts files of one size tier (powers of FANOUT) into runs of at most the target
size and writes each run as one file, without a shuffle: a run is read by one
task and streamed to its file.  A manifest lists the files of a version; it is
written beside and then renamed to its number, which fails if another writer
was first.  Readers see whole versions only, and files go when no manifest that
is kept names them.  DataFrame functions only.
"""

import json
import math
import uuid

from codequarry.llm.workspace import filesystem

FANOUT = 4
#: Runs that one job writes at most.
RUNS = 64


class ShardTable:
    """A table of shards at a path of the shared file system, with one schema; files of target_bytes are whole."""

    def __init__(self, spark, path, schema, target_bytes=128 << 20):
        self.spark, self.path, self.schema, self.target = spark, path.rstrip("/"), schema, target_bytes

    def _list(self, path):
        fs, at = filesystem(self.spark, path)
        return [(str(s.getPath().toString()), s.getLen()) for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self):
        """Numbers of the committed versions, rising."""
        return sorted(int(p.rsplit("/", 1)[1][:-5]) for p, _ in self._list(f"{self.path}/manifests") if p.endswith(".json"))

    def manifest(self, version=None):
        """{version, shards: [{file, bytes, tier}]}; version 0 is empty."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        if not version:
            return {"version": 0, "shards": []}
        text = self.spark.read.text(f"{self.path}/manifests/{version:020d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, base, shards):
        """The next version after `base`, or an error if there is one already."""
        jvm = self.spark._jvm
        version = base["version"] + 1
        final = f"{self.path}/manifests/{version:020d}.json"
        fs, temp = filesystem(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": version, "shards": shards}).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        files.rename(temp, jvm.org.apache.hadoop.fs.Path(final), options)
        return {"version": version, "shards": shards}

    def _tier(self, size):
        return max(0, int(math.log(max(size, 1) / (1 << 20), FANOUT))) if size > 1 << 20 else 0

    def _written(self, df):
        """Writes df below data/ and returns its files."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return [{"file": p, "bytes": n, "tier": self._tier(n)} for p, n in sorted(self._list(at)) if p.endswith(".parquet")]

    def _land(self, new, change):
        """Commits change(shards) as a new version, again after a lost race; the new files go if that can't be."""
        while True:
            base = self.manifest()
            try:
                return self._commit(base, change(base["shards"]))
            except Exception as e:
                if isinstance(e, RuntimeError) or self.manifest()["version"] == base["version"]:
                    self._delete(new)
                    raise

    def _delete(self, shards):
        for s in shards:
            fs, at = filesystem(self.spark, s["file"])
            fs.delete(at, False)

    def append(self, df):
        """Adds an arrival: its files, in a new version; an empty one adds no rows.  df has the table's columns, others are left out."""
        new = self._written(df.select([f.name for f in self.schema]))
        return self._land(new, lambda shards: shards + new)

    def runs(self, shards):
        """Lists of files of one tier that together are of the target size at most, FANOUT files of a tier at least."""
        out = []
        tiers = {}
        for s in shards:
            if s["bytes"] < self.target / 2:
                tiers.setdefault(s["tier"], []).append(s)
        for _, same in sorted(tiers.items()):
            if len(same) < FANOUT:
                continue
            run, size = [], 0
            for s in sorted(same, key=lambda s: (-s["bytes"], s["file"])):
                if run and size + s["bytes"] > self.target:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self):
        """Merges runs until no tier has FANOUT files; each round is one version."""
        while True:
            base = self.manifest()
            runs = self.runs(base["shards"])
            if not runs:
                return base
            gone = {s["file"] for r in runs for s in r}
            new = []
            for i in range(0, len(runs), RUNS):
                parts = [self.spark.read.schema(self.schema).parquet(*[s["file"] for s in r]).coalesce(1) for r in runs[i : i + RUNS]]
                whole = parts[0]
                for p in parts[1:]:
                    whole = whole.union(p)
                new += self._written(whole)

            def swapped(shards, gone=gone, new=new):
                if not gone <= {s["file"] for s in shards}:
                    raise RuntimeError("another compaction was first")
                return [s for s in shards if s["file"] not in gone] + new

            self._land(new, swapped)

    def vacuum(self, keep=1):
        """Deletes the files and manifests of all versions but the last `keep`: as many as readers may still hold."""
        known = self.versions()
        live = {s["file"] for v in known[-keep:] for s in self.manifest(v)["shards"]}
        for v in known[:-keep]:
            self._delete([s for s in self.manifest(v)["shards"] if s["file"] not in live])
            fs, at = filesystem(self.spark, f"{self.path}/manifests/{v:020d}.json")
            fs.delete(at, False)

    def read(self, version=None):
        """The rows of a version, the last one unless named; none of an empty table.  Nulls and repeated rows are as they came."""
        files = [s["file"] for s in self.manifest(version)["shards"]]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
