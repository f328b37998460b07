"""For each check, what its findings put at risk in training, and what helps."""

from __future__ import annotations

ADVICE: dict[str, tuple[str, str]] = {
    "structural.episode-boundary": ("Slices of episodes take frames of others or none at all.", "Give every episode one number, a begin before its end, and its true length."),
    "structural.degenerate-episode": ("Loaders fail on parts without frames, or learn from single ones.", "Leave out empty episodes and streams, or record them again."),
    "structural.episode-continuity": ("Episodes may be lost, and splits by number are not what they seem.", "Find the missing episodes, or number those that are there anew."),
    "structural.declared-episode-count": ("Part of the dataset may be missing, or its manifest is of another version.", "Compare the manifest with the files and write it again."),
    "structural.declared-frame-count": ("Frames may be missing, or counted that are not there.", "Compare the manifest with the files and write it again."),
    "structural.shape-consistency": ("Batches can't be put together, or values change their meaning between episodes.", "Convert the stream to one type and one shape in all episodes."),
    "structural.stream-presence": ("Models see inputs at training that some episodes lack.", "Record the stream in all episodes, or leave it out of all."),
    "structural.content-measurability": ("Repeated or stuck content can't be seen in what has no fingerprint.", "Read the content too, so that it can be compared."),
    "structural.duplicate-episode": ("Copies weigh double in training and leak into evaluation.", "Keep one episode of each group."),
    "structural.stuck-stream": ("A sensor that stands still teaches that nothing moves.", "Look at the sensor and its driver, and cut the frames out."),
    "temporal.clock-measurability": ("Rates, gaps and skew can't be told where only steps are counted.", "Record the time of each frame."),
    "temporal.monotonicity": ("Order and speed of what happens are wrong wherever time goes back.", "Sort by the sensor's own clock, or leave the frames out."),
    "temporal.rate-validity": ("Whatever is resampled by this rate comes out wrong.", "Declare a rate over zero, or none."),
    "temporal.rate-conformance": ("Speeds and horizons are off by the same share.", "Declare the rate that was recorded, or look for lost frames."),
    "temporal.gap": ("Motion jumps over the time that is missing.", "Cut the episode at the gap, or find the frames."),
    "temporal.jitter": ("Equal steps in training stand for unequal times.", "Resample to even times, or look at the recorder's load."),
    "temporal.clock-skew": ("Inputs drift apart, so causes and effects no longer meet.", "Put all clocks on one source of time."),
    "temporal.start-offset": ("The first frames of one stream have no counterpart in others.", "Cut all streams to the time they share."),
    "temporal.end-offset": ("The last frames of one stream have no counterpart in others.", "Cut all streams to the time they share."),
    "temporal.rate-consistency": ("One model step stands for different times in different episodes.", "Resample all episodes to one rate."),
    "temporal.episode-duration": ("An aborted or forgotten recording is learnt like a whole one.", "Look at the episode, and cut it or leave it out."),
    "autonomy.rig-sync": ("Sensors are fused that did not see the same moment.", "Synchronise the rig, or cut its streams to the time they share."),
    "autonomy.sequence-complete": ("Tracks break where frames were dropped.", "Look at the recorder's bandwidth, and leave out broken stretches."),
    "autonomy.ego-pose-continuity": ("The vehicle jumps, and everything placed by it jumps too.", "Localise again, or leave the stretch out."),
    "autonomy.calibration-completeness": ("Pictures can't be related to the world.", "Add intrinsics and transforms of every sensor."),
    "autonomy.sensor-frame-resolution": ("A sensor's data can't be placed beside the others'.", "Name the sensor's frame, and relate it to the rig's."),
    "statistical.value-measurability": ("Normalisation has nothing to go by, or can't be tested.", "Store statistics beside the data."),
    "statistical.range-sanity": ("Normalisation by these numbers breaks the inputs.", "Compute the statistics again from the data."),
    "statistical.stored-vs-observed": ("Inputs leave the range that normalisation expects.", "Compute the statistics again from the data."),
    "statistical.saturation": ("What went on beyond the sensor's end is lost.", "Widen the sensor's range, or mark such values."),
    "statistical.extreme-outlier": ("One value decides the scale of all others.", "Look at the value, and clip or remove it."),
    "statistical.non-finite-observed": ("One such value makes a whole batch's loss useless.", "Replace or remove values that are not finite."),
    "semantic.task-quality": ("Instructions that say nothing teach nothing.", "Write what was done in each episode."),
    "semantic.stream-key-clarity": ("One stream is taken for another.", "Give each stream one clear name."),
    "semantic.annotation-integrity": ("Labels are learnt for moments they are not about.", "Move annotations into their episode, and keep one for each moment."),
    "video.media-readable": ("Frames are counted whose pictures are not there.", "Fetch or encode the files again, one for each episode."),
    "video.media-conformance": ("Pictures and states are matched that don't belong together.", "Encode the files as they are declared, or declare them as they are."),
    "provenance.completeness": ("Nobody can tell whether and how the data may be used.", "State licence, sensors, clocks, calibration, annotators and sources."),
}
