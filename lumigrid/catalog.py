"""All queries of the library with SQL that tells the same."""

from __future__ import annotations

from lumigrid.queries import apps, features, images, metrics, objects, windows

QUERIES: dict = {**images.Q, **objects.Q, **apps.Q, **features.Q, **windows.Q, **metrics.Q}
SQL: dict[str, str] = {**images.SQL, **objects.SQL, **apps.SQL, **features.SQL, **windows.SQL, **metrics.SQL}

#: Queries that SQL cannot express; their operators are tested against plain versions.
ROWS_ONLY: set[str] = {"segment_app", "watershed", "watershed_3d", "cluster_modes", "local_contrast", "tracker_stateful", "tracker_parts", "tracking_identity", "zca_whiten"}
