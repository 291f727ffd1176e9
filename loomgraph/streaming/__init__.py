"""Kept free on purpose: graphs here are static, and state lives in batch supersteps (plans.loop)."""
