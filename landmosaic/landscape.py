"""One object for a landscape through time: a thin holder of its tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.functions import columns
from landmosaic.grid import GridSpec
from landmosaic.operators import adjacency, edits, habitat, metrics, patches, timeline
from landmosaic.sources.tables import read_grid, read_landscape, write_landscape
from landmosaic.storage import materialize


class Landscape:
    """Cells with patch ids and what follows from them; every table has ``t``."""

    def __init__(self, cells: DataFrame, grid: GridSpec, connectivity: int = 4):
        self.grid = grid
        self.runs = materialize(patches.label_runs(cells, grid, connectivity))
        self.cells = patches.run_cells(self.runs)
        self.habitats: dict[str, habitat.Habitat] = {}

    @classmethod
    def of_patch_cells(cls, patch_cells: DataFrame, grid: GridSpec) -> Landscape:
        """Of cells that have their patches, or of their runs."""
        self = cls.__new__(cls)
        self.grid, self.cells, self.habitats = grid, patches.as_cells(patch_cells), {}
        if patches.are_runs(patch_cells):
            self.runs = patch_cells
        return self

    @classmethod
    def load(cls, spark, path: str, grid: GridSpec | None = None) -> Landscape:
        """A stored landscape, on the grid it was stored with unless another one is given; what was saved of it on that grid isn't computed anew."""
        found = read_landscape(spark, path)
        self = cls.of_patch_cells(found.cells, grid or found.grid or read_grid(spark, path))
        if found.derived and self.grid == found.grid:
            self.patches, self.edges = found.nodes, found.edges
        return self

    def save(self, path: str, overwrite: bool = False) -> None:
        write_landscape(path, self.cells, self.patches, self.edges, overwrite, grid=self.grid, derived=True)

    @property
    def crs(self) -> str:
        return self.grid.crs

    @property
    def bounds(self) -> DataFrame:
        """``t, xmin, ymin, xmax, ymax`` of each slice."""
        return self.patches.groupBy("t").agg(*[f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))])

    @property
    def classes(self) -> DataFrame:
        return columns.classes(self.cells)

    def graph_sizes(self) -> DataFrame:
        """``habitat, t, nodes, edges`` of the graph (habitat null) and of every habitat."""
        out = adjacency.graph_counts(self.patches, self.edges).select(F.lit(None).cast("string").alias("habitat"), "*")
        for name, h in self.habitats.items():
            out = out.unionByName(adjacency.graph_counts(h.nodes, h.edges).select(F.lit(name).alias("habitat"), "*"))
        return out

    @cached_property
    def runs(self) -> DataFrame:
        """The runs of the patches, from which all else follows."""
        return patches.stored_runs(self.cells)

    @cached_property
    def patches(self) -> DataFrame:
        return patches.patch_metrics(patches.patch_table(self.runs, self.grid))

    @cached_property
    def edges(self) -> DataFrame:
        return adjacency.adjacency(self.runs)

    @cached_property
    def components(self) -> DataFrame:
        return habitat.components(self.patches, self.edges)

    @property
    def times(self) -> DataFrame:
        return timeline.times(self.cells)

    def __getitem__(self, t) -> Landscape:
        return Landscape.of_patch_cells(timeline.slice_at(self.runs, t), self.grid)

    def __len__(self) -> int:
        return self.cells.select("t").distinct().count()

    def get_metric(self, name: str, class_value=None) -> DataFrame:
        return metrics.get_metric(name, self.patches, class_value, self.components if name in metrics.UNITS["component"] else None, habitat.distinct_distances(self.components, self.runs, self.grid) if name == "avg_component_isolation" else None)

    @cached_property
    def component_distances(self) -> DataFrame:
        return habitat.component_distances(self.components, self.runs, self.grid)

    def get_class_metrics(self, names: list[str] | str | None = None, classes: list | None = None) -> DataFrame:
        names = [names] if isinstance(names, str) else names or list(metrics.UNITS["class"])
        return metrics.class_metrics(self.patches, classes).select("t", "class_label", *names)

    def get_patch_metrics(self, aggregator="mean") -> DataFrame:
        return metrics.patch_aggregates(self.patches, aggregator)

    def add_habitat(self, name: str, valid_classes: list, **options) -> habitat.Habitat:
        self.habitats[name] = habitat.add_habitat(self.runs, self.grid, name, valid_classes, **options)
        return self.habitats[name]

    def node_map(self, mode: str = "interior") -> DataFrame:
        return timeline.node_map(self.runs, mode, self.grid)

    def dynamics(self) -> DataFrame:
        return timeline.dynamics(self.node_map(), self.patches)

    def merge_classes(self, class_list: list, new_name: str) -> Landscape:
        return Landscape.of_patch_cells(edits.merge_classes(self.cells, class_list, new_name, self.edges)[0], self.grid)

    def metrics_of_graphs(self) -> DataFrame:
        """The long table of landscape, class and component metrics of the graph (habitat null) and, alike, of every habitat."""

        def levels(nodes: DataFrame, edges: DataFrame, name: str | None) -> DataFrame:
            rows = metrics.metrics_long(metrics.landscape_metrics(nodes), "landscape", name)
            rows = rows.unionByName(metrics.metrics_long(metrics.class_metrics(nodes), "class", name))
            return rows.unionByName(metrics.metrics_long(metrics.component_metrics(habitat.components(nodes, edges), nodes), "component", name))

        out = levels(self.patches, self.edges, None)
        for name, h in self.habitats.items():
            out = out.unionByName(levels(self.patches.join(h.nodes.select("t", "patch_id"), ["t", "patch_id"], "left_semi"), h.edges, name))
        return out
