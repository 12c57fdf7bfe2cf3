"""All registries of the core."""

from orderloom.plans import cell_queries, crowding_queries, event_queries, inference_queries, model_queries, problem_queries, record_queries, schedule_queries, study_queries, summary_queries, tail_queries, tape_queries


def registries() -> list:
    return [problem_queries.R, crowding_queries.R, tape_queries.R, summary_queries.R, schedule_queries.R, model_queries.R, study_queries.R, record_queries.R, inference_queries.R, event_queries.R, cell_queries.R, tail_queries.R]
