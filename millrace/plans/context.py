"""Everything a query over one event log needs, built on demand and at most once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from millrace.model import Settings
from millrace.operators import automation, conformance, discovery, enrich, marts, throughput
from millrace.sources.tables import written


class Log:
    """An event log: events (case_id, activity, ts, event_seq, resource, event_value) and case attributes."""

    def __init__(self, events: DataFrame, attributes: DataFrame, settings: Settings = Settings()):
        self.events, self.attributes, self.settings = events, attributes, settings

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession

    @cached_property
    def log(self) -> DataFrame:
        return enrich.enriched(self.events, self.settings)

    @cached_property
    def facts(self) -> DataFrame:
        return enrich.case_facts(self.log, self.settings.roles)

    @cached_property
    def whole(self) -> DataFrame:
        """Every case with attributes, flow and all facts: the one join by case."""
        return marts.case_table(self.attributes, self.facts)

    @cached_property
    def kept(self) -> DataFrame:
        """The same as a table in the shared folder, for what reads it more than once: the log is shuffled once, not for each branch.

        A row a case, far smaller than the log; it stays until the folder is cleared, since lazy results read it.
        """
        return written(self.whole, "cases")

    @cached_property
    def cases(self) -> DataFrame:
        return self._cases(self.whole)

    @cached_property
    def kept_cases(self) -> DataFrame:
        return self._cases(self.kept)

    def _cases(self, whole: DataFrame) -> DataFrame:
        return whole.select("case_id", *self.case_columns, "flow_type", *enrich.METRICS)

    @property
    def case_columns(self) -> list[str]:
        return [c for c in self.attributes.columns if c != "case_id"]

    @cached_property
    def repeats(self) -> DataFrame:
        return self.facts.select("case_id", *enrich.REPEATS)

    @cached_property
    def steps(self) -> DataFrame:
        return discovery.transitions(self.log)

    @cached_property
    def flow_steps(self) -> DataFrame:
        return self.steps.join(self.cases.select("case_id", "flow_type"), "case_id")

    @cached_property
    def variants(self) -> DataFrame:
        return discovery.variant_stats(self.cases, self.settings)

    @cached_property
    def checked(self) -> DataFrame:
        """Every case with its facts and the array of its checks."""
        return conformance.case_checks(self.kept, self.kept, self.settings)

    @cached_property
    def checked_once(self) -> DataFrame:
        """The same for what reads it once: only the limits of the flows read the log a second time, for starts and ends."""
        made = self.__dict__.get("checked")
        return made if made is not None else conformance.case_checks(self.whole, self.attributes, self.settings)

    @cached_property
    def checks(self) -> DataFrame:
        return conformance.compliance_checks(self.checked_once)

    @cached_property
    def scores(self) -> DataFrame:
        return conformance.compliance_scores(self.checked_once)

    @cached_property
    def scored(self) -> DataFrame:
        """Cases with attributes and scores, for reports by attribute."""
        return conformance.with_scores(self.checked)

    @cached_property
    def profile(self) -> DataFrame:
        return enrich.activity_profile(self.log, self.settings)

    @cached_property
    def bottlenecks(self) -> DataFrame:
        return throughput.bottlenecks(self.steps, self.settings)

    @cached_property
    def graph(self) -> DataFrame:
        return discovery.dfg_edges(self.steps, self.settings)

    @cached_property
    def automation(self) -> DataFrame:
        return automation.automation_score(self.log, self.settings)

    @cached_property
    def summary(self) -> DataFrame:
        return marts.fact_case_summary(self.checked, self.case_columns, self.settings)

    def cached(self) -> Log:
        """Keep the enriched log and the checked cases in memory and on disk for a run of many queries; see release."""
        self.log = self.log.persist()
        self.checked = self.checked.persist()
        self.whole = self.kept = self.checked
        return self

    def release(self) -> None:
        self.log.unpersist()
        self.checked.unpersist()
