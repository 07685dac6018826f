"""Plans of several steps: smoothing, moments, multiscale, label propagation."""
