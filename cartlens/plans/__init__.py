"""Business plans: staging, model, analyses, checks, metrics, reports, publishing."""
