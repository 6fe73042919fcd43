from postmart.plans.runs import reconcile_status  # noqa: F401
from postmart.plans.serve import list_posts, refresh_labels, reindex  # noqa: F401
from postmart.plans.snapshot import simulation_snapshot  # noqa: F401
