"""Latent-state, clustering, econometric, state-space and supervised models."""
