"""The nine-step study as a run that keeps each step's table and may start at any step."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.operators import cleaning, filters, graph, pairing, places, regression, resample, spatial

from .tables import StaleStep, Store, fingerprint, steps_of

#: Settings of the steps and their defaults; ``cell`` is the grid's width in the points' units, ``buffer`` is in metres.
DEFAULTS = {"cell": 0.1, "least": 20, "years": 3.0, "buffer": 30.0, "least_pairs": 10, "without": ()}
Inputs = Mapping[str, DataFrame]
Done = Callable[[str], DataFrame]


def upstream(inputs: Inputs, done: Done, how: Mapping) -> DataFrame:
    """1: links above each terminal gage; needs ``network(link, below)`` and ``gages(id, link)``."""
    net = graph.edges(inputs["network"])
    found = graph.upstream_links(graph.terminal_groups(inputs["gages"], net), net)
    return filters.without_groups(found.withColumnRenamed("gage", "grp"), list(how["without"]))


def members(inputs: Inputs, done: Done, how: Mapping) -> DataFrame:
    """2: entities in the catchments above each gage; needs ``points(entity, x, y)`` and ``catchments(polygon_id, ring)``."""
    above = done("upstream").select("grp", F.col("upstream_link").alias("polygon_id"))
    return places.entities_in_catchments(inputs["points"], inputs["catchments"], above, how["cell"]).select("entity", "grp", "polygon_id").distinct()


def reaches(inputs: Inputs, done: Done, how: Mapping) -> DataFrame:
    """3: nearest reach of each member and its elevation; needs ``lines(line_id, line)`` and ``elevations(line_id, reach_elevation)``."""
    own = inputs["points"].join(done("members").select("entity").distinct(), "entity", "left_semi")
    near = spatial.nearest_line(own, inputs["lines"], how["cell"], point_id="entity")
    return near.join(inputs["elevations"].select("line_id", "reach_elevation"), "line_id", "left")


def checked(inputs: Inputs, done: Done, how: Mapping) -> DataFrame:
    """4: levels of members without outliers and with enough rows and years; needs ``levels(entity, date, wte)``."""
    own = inputs["levels"].join(done("members").select("entity").distinct(), "entity", "left_semi")
    return cleaning.enough_years(cleaning.without_outliers(own), least=how["least"], years=how["years"])


def monthly(inputs: Inputs, done: Done, how: Mapping) -> DataFrame:
    """5: levels on the 15th of each month."""
    return resample.pchip(done("checked"))


def near_stream(inputs: Inputs, done: Done, how: Mapping) -> DataFrame:
    """6: levels whose reach lies at most the buffer above them."""
    rows, _ = filters.elevation_filter(done("monthly"), done("reaches"), how["buffer"])
    return rows


def paired(inputs: Inputs, done: Done, how: Mapping) -> DataFrame:
    """7: levels and flows of one gage and month; needs ``flows(grp, date, q, bfd)``."""
    own = done("near_stream").select("entity", "date", "wte").join(done("members").select("entity", "grp").distinct(), "entity")
    both = pairing.pair(own, pairing.monthly_response(inputs["flows"]))
    return both.select("grp", "date", "entity", "wte", "q", "bfd")


def deltas(inputs: Inputs, done: Done, how: Mapping) -> DataFrame:
    """8: differences against each entity's first flagged month."""
    return pairing.with_deltas(pairing.with_baseline(done("paired")))


def fits(inputs: Inputs, done: Done, how: Mapping) -> DataFrame:
    """9: least squares and correlations of each pair."""
    return regression.regression_by_pair(done("deltas"), least=how["least_pairs"])


STEPS = (upstream, members, reaches, checked, monthly, near_stream, paired, deltas, fits)


class _Used(Mapping):
    """A mapping that notes what is read from it."""

    def __init__(self, of: Mapping):
        self.of, self.read = of, set()

    def __getitem__(self, key):
        self.read.add(key)
        return self.of[key]

    def __iter__(self):
        return iter(self.of)

    def __len__(self):
        return len(self.of)


def _told(value) -> object:
    return list(value) if isinstance(value, (list, tuple, set)) else value


def run(store: Store, inputs: Inputs, steps: str = "all", **how) -> DataFrame:
    """Runs ``steps`` (as :func:`steps_of` reads them) and returns the last one's table.

    Each step commits its table to the store under the function's name, with a manifest of the inputs (by fingerprint), settings and earlier
    steps it has read. An earlier step that is read again must fit: if it is missing or half-written, was made with other settings or
    other inputs than this run names, or from a step that has been written anew since, the run raises :class:`StaleStep`. Inputs are needed
    only by the steps that run; inputs and settings that aren't given aren't compared. Unknown settings are errors. An input has to give the same
    rows to the last bit whenever it is read: a table does, sums of doubles after a shuffle may not, so write those first.
    """
    unknown = set(how) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    settings, prints, fits = DEFAULTS | how, {}, {}

    def print_of(name: str) -> str:
        if name not in prints:
            prints[name] = fingerprint(inputs[name])
        return prints[name]

    def checked_id(name: str) -> str:
        """The id of a kept step, once it is known to fit."""
        if name not in fits:
            kept = store.manifest(name)
            made = kept["made_from"]
            if made is not None:
                for key, value in made["settings"].items():
                    if key in how and value != _told(how[key]):
                        raise StaleStep(f"step {name} was made with {key} = {value}, not {_told(how[key])}")
                for key, value in made["inputs"].items():
                    if key in inputs and value != print_of(key):
                        raise StaleStep(f"step {name} was made from other rows of {key}")
                for key, value in made["steps"].items():
                    if value != checked_id(key):
                        raise StaleStep(f"step {name} was made before step {key} was written anew")
            fits[name] = kept["id"]
        return fits[name]

    first, last = steps_of(steps, len(STEPS))
    for step in STEPS[first - 1 : last]:
        given, set_, before = _Used(inputs), _Used(settings), {}

        def done(name: str, before=before) -> DataFrame:
            before[name] = checked_id(name)
            return store.load(name)

        table = step(given, done, set_)
        made = {"settings": {k: _told(settings[k]) for k in sorted(set_.read)}, "inputs": {k: print_of(k) for k in sorted(given.read)}, "steps": before}
        store.save(step.__name__, table, made)
        fits.pop(step.__name__, None)
    return store.load(STEPS[last - 1].__name__)


def observed(store: Store) -> DataFrame:
    """``(step, rows, about_entity, about_grp, first_date, last_date)``: what was observed while each step was written."""
    rows = []
    for step in STEPS:
        try:
            seen = store.manifest(step.__name__)["observed"]
        except StaleStep:
            continue
        rows.append((step.__name__, *[seen.get(c) for c in ("rows", "about_entity", "about_grp", "first_date", "last_date")]))
    return store.spark.createDataFrame(rows, "step string, rows long, about_entity long, about_grp long, first_date string, last_date string")
