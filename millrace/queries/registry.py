"""All registered queries by name."""

from millrace.queries import configs, datasets, files, generation, responses, streams, telemetry

REGISTRY = {
    **datasets.QUERIES, **responses.QUERIES, **configs.QUERIES, **telemetry.QUERIES,
    **files.QUERIES, **generation.QUERIES, **streams.QUERIES,
}
