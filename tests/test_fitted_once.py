"""The chosen models of a search are shared by the queries that score with them."""

from ionforge.plans import flows


def test_models_are_fitted_once_until_the_search_changes(spark, monkeypatch):
    class Found:
        fits, open = 0, 4

        def run(self):
            now, self.open = self.open, 0
            return now

        def summary(self):
            return spark.createDataFrame([("li_only", "krr", True)], "population string, family string, selected boolean")

        def select(self, summary):
            return summary

        def final_models(self, selection):
            self.fits += 1
            return {r.population: [(r.family, f"model {self.fits}")] for r in selection.collect()}

    found = Found()
    monkeypatch.setattr(flows, "search", lambda spark, sf: found)
    for _ in range(2):
        fitted, defaults = flows.fitted(spark, "anywhere")
        assert fitted == {("li_only", "krr"): "model 1"} and [tuple(r) for r in defaults.collect()] == [("li_only", "krr")]
    found.open = 1  # a task was run anew
    assert flows.fitted(spark, "anywhere")[0] == {("li_only", "krr"): "model 2"}
