"""Geometry functions: native expressions, numpy kernels, projections."""
