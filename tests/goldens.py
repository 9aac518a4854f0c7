"""Inputs and outputs that the passes have to reproduce."""

PASSES = [
    ("course_correction", "let's meet tomorrow no wait let's do friday", "let's do friday"),
    ("course_correction", "send to john scratch that send to mike", "send to mike"),
    ("course_correction", "it costs ten i mean twenty dollars", "twenty dollars"),
    ("course_correction", "we should go left or rather right", "right"),
    ("course_correction", "not tomorrow but friday", "friday"),
    ("course_correction", "send to john no sorry send to mike", "send to mike"),
    ("course_correction", "this is perfectly fine", "this is perfectly fine"),
    ("course_correction", "a\nb no wait c", "a\nb no wait c"),
    ("course_correction", "a\nb no sorry c", "a\nc"),
    ("clean_repetitions", "I I I think", "I think"),
    ("clean_repetitions", "the the problem", "the problem"),
    ("clean_repetitions", "you know you know", "you know"),
    ("clean_repetitions", "hello world", "hello world"),
    ("clean_repetitions", "the the the the", "the"),
    ("clean_repetitions", "señor señor a", "señor a"),
    ("remove_fillers", "I uh think um yes", "I think yes"),
    ("remove_fillers", "it was you know really good", "it was really good"),
    ("remove_fillers", "like we should go", "we should go"),
    ("remove_fillers", "this is fine", "this is fine"),
    ("remove_fillers", "was, you know, good", "was, good"),
    ("spoken_punctuation", "hello period goodbye", "hello. goodbye"),
    ("spoken_punctuation", "first comma second", "first, second"),
    ("spoken_punctuation", "are you sure question mark", "are you sure?"),
    ("spoken_punctuation", "line one new line line two", "line one\nline two"),
    ("spoken_punctuation", "wow exclamation point", "wow!"),
    ("spoken_punctuation", "periodically we check", "periodically we check"),
    ("spoken_punctuation", "that is all period", "that is all."),
    ("spoken_punctuation", "a period period b", "a.. b"),
    ("spoken_punctuation", "say open paren hi close paren ok", "say( hi) ok"),
    ("spoken_punctuation", "a dash", "a — "),
    ("spoken_punctuation", "hello period\nnext", "hello. \nnext"),
    ("capitalize", "hello. goodbye? yes! absolutely\nnext line", "Hello. Goodbye? Yes! Absolutely\nNext line"),
    ("capitalize", 'hello. "goodbye, friend"', 'Hello. "Goodbye, friend"'),
    ("capitalize", "first, second", "First, second"),
    ("capitalize", "use ONNX Runtime 1.24 today", "Use ONNX Runtime 1.24 today"),
    ("restore_contractions", "It is fine", "It's fine"),
    ("restore_contractions", "I am here", "I'm here"),
    ("restore_contractions", "Can not do it", "Can't do it"),
    ("restore_contractions", "a bit isolated", "a bit isolated"),
    ("restore_contractions", "scan nothing", "scan nothing"),
    ("restore_contractions", "I have a car", "I have a car"),
    ("restore_contractions", "let us know", "let us know"),
    ("restore_contractions", "it is what it is", "it's what it's"),
    (
        "restore_contractions",
        "it is awesome I can not wait I know I am freaking out you are a very good actor",
        "it's awesome I can't wait I know I'm freaking out you're a very good actor",
    ),
    ("fix_transcription", "there is no way she is not guilty", "There is no way she is not guilty"),
    ("fix_transcription", "i went to the store", "I went to the store"),
    ("fix_transcription", "", ""),
    ("fix_transcription", "Hello world.", "Hello world."),
    ("fix_transcription", "i think this is really great period and i hope it works", "I think this is really great. And I hope it works"),
    ("fix_transcription", "i uh deployed to the the cluster period no wait i rolled it back period", "I rolled it back."),
    ("fix_transcription", "I uh deployed to the the cluster. No wait, I rolled it back.", "I rolled it back."),
]
TERMS = ["Kubernetes", "Wayland", "Svelte", "Tauri", "Syncthing"]
WITH_TERMS = [
    ("i uh deployed tori to the the kubernetis cluster on wayland period", "I deployed Tauri to the Kubernetes cluster on Wayland."),
    ("I uh deployed Tori to the the Kubernetis cluster on Wayland.", "I deployed Tauri to the Kubernetes cluster on Wayland."),
]
