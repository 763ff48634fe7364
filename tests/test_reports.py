from clicktrail.functions.temporal import known_zones
from clicktrail.plans import jobs as P
from clicktrail.registry.trace_queries import NO_CUTOFF, survey_stages
from clicktrail.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_reports_run(spark):
    raw, resp, pages = T.raw_survey(spark, SF), T.responses_log(spark, SF), T.page_table(spark, SF)
    init = T.initiation_log(spark, SF)
    qa = P.qa_report(init, resp, raw, T.flat_request_log(spark, SF), pages, "2024-01-05", "2024-01-10")
    assert qa["funnel"].count() == 5 and qa["funnel_rates"].count() == 1
    dist = P.distribution_report(P.survey_in_el(raw, resp, NO_CUTOFF))
    assert dist["n_motivations"].count() >= 1
    st = survey_stages(spark, SF)
    assert P.temporal_report(st.responses, known_zones(spark), draws=200).count() > 0


def test_known_zones_hold_plain_names(spark):
    zones = set(known_zones(spark))
    assert {"UTC", "GMT", "Japan", "Singapore", "America/New_York"} <= zones and "Mars/Olympus_Mons" not in zones
