"""Tables from images, spectra and files, and back."""
