"""Multi-step plans: profiling, preflight, reports and run contracts."""
