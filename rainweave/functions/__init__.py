"""Column-level functions: time, rate, geometry, attenuation, activation."""
