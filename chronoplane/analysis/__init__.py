"""Attribution of metrics to phases, bottlenecks, reports."""
